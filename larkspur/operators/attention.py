"""A small attention scorer of token sequences, fitted by class centroids. All of it is column expressions and aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp, dot, let, safe_logit, sigmoid, softmax
from .intent import ladder
from .sequences import UNKNOWN, UNKNOWN_TOKEN, event_tokens



def base_vector(token_id: Column, dim: int) -> Column:
    """The part of an embedding that the token decides: hashed numbers from -1 to 1."""
    one = lambda d: F.conv(F.substring(F.sha2(F.concat(token_id.cast("string"), F.lit(":"), d.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def place_vector(position: Column, dim: int) -> Column:
    """The part that the padded position decides."""
    return F.array(*[F.sin((position + 1) / F.lit(10000.0 ** (d / dim))) for d in range(dim)])


def embedding(base: Column, position: Column, dim: int) -> Column:
    return F.zip_with(base, place_vector(position, dim), lambda b, p: b * 0.85 + p * 0.15)


@dataclass(frozen=True)
class Fitted:
    weight: list[float]
    bias: float
    positive_rate: float
    scores: DataFrame  # token, score


@dataclass(frozen=True)
class AttentionModel:
    length: int = 20
    dim: int = 16
    version: str = "tiny-attention-recommender-v1"

    def attended(self, found: DataFrame, vocab: DataFrame, scores: DataFrame | None = None) -> DataFrame:
        """pos, label, steps (array of at, id, token, score, weight, attention) and context of each example.

        attention is the softmax weight at 4 decimals; the context uses it unrounded. Vocabularies are joined once, with
        their hashed vectors computed once for each token.
        """
        n = F.size("tokens")
        last = F.expr(f"if(size(tokens) > {self.length}, slice(tokens, -{self.length}, {self.length}), tokens)")
        spread = found.select("pos", "label", F.posexplode_outer(last).alias("k", "asked"), F.least(n, F.lit(self.length)).alias("n")).withColumn("at", F.lit(self.length) - F.col("n") + F.col("k"))
        known = vocab.where("id > 0").select("token", "id", base_vector(F.col("id"), self.dim).alias("base"))
        if scores is not None:
            known = known.join(scores, "token", "left")
        else:
            known = known.withColumn("score", F.lit(None).cast("double"))
        unknown = base_vector(F.lit(UNKNOWN), self.dim)
        joined = spread.join(known, spread["asked"] == known["token"], "left")
        step = F.struct("at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"), F.coalesce("token", F.lit(UNKNOWN_TOKEN)).alias("token"), "score", embedding(F.coalesce("base", unknown), F.col("at"), self.dim).alias("v"))
        grouped = joined.groupBy("pos").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), step)), lambda x, y: x.at - y.at).alias("raw"))
        points = let(F.element_at("raw", -1).v, lambda q: F.transform("raw", lambda s: dot(q, s.v) / math.sqrt(self.dim) + s.at * 0.03))
        weights = F.when(F.size("raw") > 0, softmax(points)).otherwise(F.array().cast("array<double>"))
        grouped = grouped.withColumn("w", weights)
        none = F.array_repeat(F.lit(0.0), self.dim)
        context = F.aggregate(F.zip_with("raw", "w", lambda s, w: F.transform(s.v, lambda x: x * w)), none, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        steps = F.zip_with("raw", "w", lambda s, w: F.struct(s.at.alias("at"), s.id.alias("id"), s.token.alias("token"), s.score.alias("score"), w.alias("weight"), F.round(w, 4).alias("attention")))
        return grouped.select("pos", "label", steps.alias("steps"), context.alias("context"))

    def fit(self, train: DataFrame, vocab: DataFrame) -> Fitted:
        """Three aggregates: the positive rate, each token's mean label, and the two classes' mean contexts."""
        scores = train.select("label", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.avg("label").alias("score"))
        spread = self.attended(train, vocab).select("label", F.posexplode("context").alias("d", "x"))
        mean = lambda y: F.coalesce(F.avg(F.when(F.col("label") == y, F.col("x"))), F.lit(0.0))
        rows = spread.groupBy("d").agg(((mean(1) - mean(0)) * 0.75).alias("w")).orderBy("d").collect()  # one for each dimension
        if not rows:
            raise ValueError("fitting needs at least one example")
        totals = train.agg(F.avg("label").alias("rate"), safe_logit(F.avg("label")).alias("bias")).first()
        return Fitted([r.w for r in rows], float(totals.bias), float(totals.rate), scores)

    def predict(self, asked: DataFrame, vocab: DataFrame, fitted: Fitted) -> DataFrame:
        """pos, user_id, purchase_probability, confidence, label (as text), sequence_length, important (five tokens), truth."""
        seen = self.attended(asked, vocab, fitted.scores)
        rate = F.lit(fitted.positive_rate)
        signal = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x.attention * (F.coalesce(x.score, rate) - rate)) * 6.0
        recent = F.expr("if(size(tokens) > 8, slice(tokens, -8, 8), tokens)")
        has = lambda t, v: F.when(F.array_contains("recent", t), v).otherwise(0.0)
        behaviour = has("event:add_to_cart", 0.9) + has("event:purchase", 1.2) + F.when(F.size(F.filter("recent", lambda t: t == "event:view")) >= 3, 0.25).otherwise(0.0)
        known = asked.select("pos", F.explode("tokens").alias("token")).join(vocab, "token", "left").groupBy("pos").agg(F.avg(F.col("id").isNotNull().cast("int")).alias("known"))
        own = asked.select("pos", "user_id", "tokens", recent.alias("recent"), F.col("label").alias("truth"))
        rows = own.join(seen.drop("label"), "pos").join(known, "pos", "left")
        score = F.lit(fitted.bias) + dot(F.col("context"), F.array(*map(F.lit, fitted.weight))) + signal + behaviour
        rows = rows.withColumn("p", sigmoid(score))
        rows = rows.withColumn("c", clamp(F.abs(F.col("p") - 0.5) + 0.45 + F.coalesce("known", F.lit(0.0)) * 0.25, 0.1, 1.0))
        return rows.select(
            "pos", "user_id", F.round("p", 4).alias("purchase_probability"), F.round("c", 4).alias("confidence"), ladder(F.col("c"), F.col("p"), 0.45, 0.65, 0.4).alias("label"),
            F.size("tokens").alias("sequence_length"), top_tokens(F.col("steps")).alias("important"), "truth", F.lit(self.version).alias("model_version"),
        )


def top_tokens(steps: Column, most: int = 5) -> Column:
    """The steps with the largest rounded attention, of equal ones the earlier."""
    ordered = F.array_sort(steps, lambda a, b: F.when(a.attention != b.attention, F.when(a.attention > b.attention, -1).otherwise(1)).otherwise(a.at - b.at))
    return F.transform(F.slice(ordered, 1, most), lambda s: F.struct(s.token.alias("token"), s.at.alias("position"), s.attention.alias("attention")))


def binary_metrics(judged: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts of rows (truth, guess)."""
    count = lambda t, g: F.count_if((F.col("truth") == t) & (F.col("guess") == g))
    c = judged.agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), F.count("*").alias("n"))
    c = c.withColumn("p", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("r", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    f1 = F.col("p") * 2 * F.col("r") / F.greatest(F.lit(1e-6), F.col("p") + F.col("r"))
    accuracy = (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n"))
    return c.select(F.round(accuracy, 4).alias("accuracy"), F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), "tp", "tn", "fp", "fn")


def evaluate(predictions: DataFrame) -> DataFrame:
    """Metrics of predictions, judged at 0.5 by their rounded probabilities."""
    return binary_metrics(predictions.select("truth", (F.col("purchase_probability") >= 0.5).cast("int").alias("guess")))


def save(fitted: Fitted, model: AttentionModel, path: str, spark: SparkSession) -> None:
    row = [(model.length, model.dim, model.version, fitted.weight, fitted.bias, fitted.positive_rate)]
    spark.createDataFrame(row, "length int, dim int, version string, weight array<double>, bias double, positive_rate double").write.mode("overwrite").parquet(f"{path}/model")
    fitted.scores.write.mode("overwrite").parquet(f"{path}/scores")


def load(path: str, spark: SparkSession) -> tuple[AttentionModel, Fitted]:
    r = spark.read.parquet(f"{path}/model").first()
    return AttentionModel(r.length, r.dim, r.version), Fitted(list(r.weight), r.bias, r.positive_rate, spark.read.parquet(f"{path}/scores"))


def asked_from_events(events: DataFrame) -> DataFrame:
    """Each user's whole history as the rows that predict() takes: pos (the last event's), user_id, tokens, label 0."""
    one = F.struct("timestamp", "pos", event_tokens().alias("tokens"))
    grouped = events.groupBy("user_id").agg(F.max("pos").alias("pos"), F.array_sort(F.collect_list(one)).alias("h"))
    return grouped.select("pos", "user_id", F.flatten(F.col("h.tokens")).alias("tokens"), F.lit(0).alias("label"))
