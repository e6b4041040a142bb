"""The registry of features."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Feature:
    name: str
    key_pattern: str
    source: str
    value_type: str
    description: str
    used_by: tuple[str, ...] = ()


# The registered features, as name, source, value type, description.
_BOTH, _INTENT, _REPORTS = ("purchase-intent-v1", "tiny-attention-recommender-v1"), ("purchase-intent-v1",), ("reporting", "lineage")
DEFAULTS = (
    Feature("event_count", "feature:user:{user_id}:event_count", "batch", "number", "Total number of historical events observed for a user.", _BOTH),
    Feature("click_count", "feature:user:{user_id}:click_count", "batch", "number", "Number of historical click-like events observed for a user.", _BOTH),
    Feature("purchase_count", "feature:user:{user_id}:purchase_count", "batch", "number", "Number of historical purchase events observed for a user.", _BOTH),
    Feature("total_purchase_amount", "feature:user:{user_id}:total_purchase_amount", "batch", "number", "Total purchase amount observed for a user.", _BOTH),
    Feature("recent_event_count", "feature:user:{user_id}:window:{window_start}:event_count", "stream", "number", "Number of recent events for a user inside a stream window.", _INTENT),
    Feature("recent_click_count", "feature:user:{user_id}:window:{window_start}:click_count", "stream", "number", "Number of recent click-like events inside a stream window.", _INTENT),
    Feature("recent_purchase_count", "feature:user:{user_id}:window:{window_start}:purchase_count", "stream", "number", "Number of recent purchases inside a stream window.", _INTENT),
    Feature("recent_total_purchase_amount", "feature:user:{user_id}:window:{window_start}:total_purchase_amount", "stream", "number", "Recent purchase amount inside a stream window.", _INTENT),
    Feature("purchase_probability", "prediction:user:{user_id}:purchase_probability", "model", "number", "Purchase probability produced by an inference model.", _REPORTS),
    Feature("prediction_label", "prediction:user:{user_id}:label", "model", "string", "Readable prediction label produced by an inference model.", _REPORTS),
)


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)

    @classmethod
    def default(cls) -> Registry:
        out = cls()
        for f in DEFAULTS:
            out.register(f)
        return out

    def register(self, feature: Feature) -> None:
        if feature.name in self.features:
            raise ValueError(f"{feature.name} is registered already")
        self.features[feature.name] = feature

    def get(self, name: str) -> Feature | None:
        return self.features.get(name)

    def require(self, name: str) -> Feature:
        if name not in self.features:
            raise KeyError(f"{name} isn't registered")
        return self.features[name]

    def listed(self, source: str | None = None) -> list[Feature]:
        return sorted((f for f in self.features.values() if source in (None, f.source)), key=lambda f: f.name)

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "name string, key_pattern string, source string, value_type string, description string, used_by array<string>"
        return spark.createDataFrame([tuple((asdict(f) | {"used_by": list(f.used_by)}).values()) for f in self.listed()], schema)
