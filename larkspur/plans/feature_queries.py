"""Queries over events: batch and window features, validation, serving, scoring, the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import features as ft
from ..operators import intent
from ..operators import quality as ql
from ..operators.catalog import DEFAULTS, Registry
from ..operators.mapreduce import map_reduce
from ..sources.events import table_events
from ..sources.records import unpivoted
from . import rounded as rd
from . import sql
from .registry import query

DAY = 86_400


@query(f"WITH {sql.WIDE} SELECT * FROM wide")
def batch_user_features(spark: SparkSession, d: str) -> DataFrame:
    return rd.user_features(table_events(spark, d))


@query(f"WITH {sql.WIDE} {sql.BATCH_CELLS}")
def batch_features_kv(spark: SparkSession, d: str) -> DataFrame:
    return ft.as_cells(rd.user_features(table_events(spark, d)))


_PAIRS = """pairs AS (SELECT pos, user_id, 'event_count' AS feature, 1::DOUBLE AS amount FROM ev UNION ALL SELECT pos, user_id, 'click_count', 1 FROM ev WHERE event_type = 'click'
  UNION ALL SELECT pos, user_id, 'purchase_count', 1 FROM ev WHERE event_type = 'purchase' UNION ALL SELECT pos, user_id, 'total_purchase_amount', coalesce(amount, 0) FROM ev WHERE event_type = 'purchase')"""


@query(f"WITH {sql.EV}, {_PAIRS} SELECT user_id, pos, feature, amount FROM pairs")
def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ft.feature_pairs(table_events(spark, d))


@query(f"WITH {sql.EV}, {_PAIRS} SELECT 'feature:user:' || user_id || ':' || feature AS key, string_agg({sql.text('amount')}, ',' ORDER BY pos) AS values FROM pairs GROUP BY ALL")
def batch_grouped_values(spark: SparkSession, d: str) -> DataFrame:
    return ft.grouped_values(table_events(spark, d))


@query(f"WITH {sql.EV}, {_PAIRS} SELECT 'feature:user:' || user_id || ':' || feature AS key, round(sum(amount), 4) AS value FROM pairs GROUP BY ALL")
def map_reduce_job(spark: SparkSession, d: str) -> DataFrame:
    """The same features through the generic job, with a Python mapper and reducer."""

    def mapper(e: dict) -> list[tuple[str, float]]:
        key = f"feature:user:{e['user_id']}:"
        out = [(key + "event_count", 1.0)]
        if e["event_type"] == "click":
            out.append((key + "click_count", 1.0))
        if e["event_type"] == "purchase":
            out += [(key + "purchase_count", 1.0), (key + "total_purchase_amount", float(e["amount"] or 0))]
        return out

    events = table_events(spark, d).select("user_id", "event_type", "amount")
    return map_reduce(events, mapper, lambda _, values: round(float(sum(values)), 4), "key string, amount double", "key string, value double")


_CHECKED = f"""{sql.EV}, chk AS (SELECT *, lower(trim(event_type)) IN ('add_to_cart', 'click', 'purchase', 'view') AS known, coalesce(amount < 0, false) AS negative FROM ev)"""


@query(f"WITH {_CHECKED} SELECT pos, event_type, CAST((NOT known)::INT + negative::INT AS BIGINT) AS issue_count, known AND NOT negative AS valid FROM chk")
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    checked = ql.validated(table_events(spark, d), require_timestamp=True)
    return checked.select("pos", "event_type", F.size("issues").cast("bigint").alias("issue_count"), (F.size("issues") == 0).alias("valid"))


_ISSUES = """iss AS (SELECT pos AS index, 'event_type' AS field, 'event_type must be one of [''add_to_cart'', ''click'', ''purchase'', ''view'']' AS message, event_type AS value FROM chk WHERE NOT known
  UNION ALL SELECT pos, 'amount', 'amount must be non-negative', CAST(amount AS VARCHAR) FROM chk WHERE negative)"""


@query(f"WITH {_CHECKED}, {_ISSUES} SELECT * FROM iss")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return ql.issue_rows(ql.validated(table_events(spark, d), require_timestamp=True))


@query(f"WITH {_CHECKED}, {_ISSUES} SELECT count(*) AS total_count, count(*) FILTER (known AND NOT negative) AS valid_count, count(*) FILTER (NOT known OR negative) AS invalid_count, (SELECT count(*) FROM iss) AS issue_count, (SELECT count(*) FROM iss) = 0 AS ok FROM chk")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return ql.quality_totals(ql.validated(table_events(spark, d), require_timestamp=True))


@query(f"""WITH {_CHECKED}, {_ISSUES} SELECT source, field, count(*) AS issue_rows, count(DISTINCT index) AS invalid_rows
  FROM (SELECT *, CASE WHEN index % 2 = 0 THEN 'batch' ELSE 'stream' END AS source FROM iss) GROUP BY ALL""")
def union_quality_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = ql.issue_rows(ql.validated(table_events(spark, d), require_timestamp=True))
    both = ql.merged_reports({"batch": rows.where("index % 2 = 0"), "stream": rows.where("index % 2 = 1")})
    return both.groupBy("source", "field").agg(F.count("*").alias("issue_rows"), F.countDistinct("index").alias("invalid_rows"))


@query(f"WITH {_CHECKED} SELECT pos, user_id, event_type FROM chk WHERE known AND NOT negative")
def valid_events(spark: SparkSession, d: str) -> DataFrame:
    return ql.valid_events(ql.validated(table_events(spark, d), require_timestamp=True)).select("pos", "user_id", "event_type")


@query("SELECT text, TRY_CAST(text AS DOUBLE) IS NOT NULL AS is_number FROM (SELECT substr(o_orderpriority, 1, 1) AS text FROM orders UNION SELECT o_orderpriority FROM orders UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT '1e3') UNION ALL SELECT * FROM (VALUES ('1d', false), ('1f', false), ('0x1p3', false), ('1_000', true), ('1__0', false), ('_1', false), (' 12.5 ', true), ('.5', true), ('5.', true), ('.', false), ('1e', false), ('-2E-3', true), ('NaN', true), ('-inf', true), ('', false), ('0.12345678901', true)) v(text, is_number)")
def numeric_predicate(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    texts = o.select(F.substring("o_orderpriority", 1, 1).alias("text")).union(o.select("o_orderpriority")).union(o.select(F.col("o_custkey").cast("string"))).union(spark.sql("select '1e3'"))
    odd = spark.createDataFrame([(t,) for t in ("1d", "1f", "0x1p3", "1_000", "1__0", "_1", " 12.5 ", ".5", "5.", ".", "1e", "-2E-3", "NaN", "-inf", "", "0.12345678901")], "text string")
    return texts.union(odd).distinct().select("text", fn.is_number(F.col("text")).alias("is_number"))


@query(f"WITH {sql.EV}, {sql.windows(60)} SELECT * FROM win")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return rd.window_features(table_events(spark, d))


@query(f"WITH {sql.EV}, {sql.windows(60)} {sql.WINDOW_CELLS}")
def window_features_kv(spark: SparkSession, d: str) -> DataFrame:
    return ft.as_cells(rd.window_features(table_events(spark, d)))


@query(f"WITH {sql.EV} SELECT pos, t - t % 60 AS window_start, t - t % 60 + 60 AS window_end FROM ev")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("timestamp")
    return table_events(spark, d).select("pos", fn.window_start(t).alias("window_start"), fn.window_end(t).alias("window_end"))


@query(f"WITH {sql.EV}, {sql.windows(DAY)} SELECT * FROM win")
def window_feature_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of events, the second added to what the first stored: the same as all at once."""
    events = table_events(spark, d)
    return ft.merged_windows(rd.window_features(events.where("pos % 2 = 0"), DAY), rd.window_features(events.where("pos % 2 = 1"), DAY))


def _recent(events: DataFrame) -> list[int]:
    first = events.agg(F.min(fn.window_start(F.col("timestamp"), DAY)).alias("s")).first().s
    return [] if first is None else [first + k * DAY for k in range(5)]


_SERVED = f"""{sql.WIDE}, {sql.windows(DAY)}, starts AS (SELECT (SELECT min(window_start) FROM win) + n * {DAY} AS s FROM range(5) r(n)),
  users AS (SELECT DISTINCT user_id FROM ev UNION ALL SELECT '999999'), rec AS (SELECT user_id, sum(event_count)::DOUBLE AS e, sum(coalesce(click_count, 0))::DOUBLE AS c, sum(coalesce(purchase_count, 0))::DOUBLE AS p,
  round(sum(coalesce(total_purchase_amount, 0)), 4) AS a, count(*) FILTER (event_count > 0) AS active FROM win WHERE window_start IN (SELECT s FROM starts) GROUP BY user_id),
  srv AS (SELECT u.user_id, coalesce(event_count, 0)::DOUBLE AS event_count, coalesce(click_count, 0)::DOUBLE AS click_count, coalesce(purchase_count, 0)::DOUBLE AS purchase_count, coalesce(total_purchase_amount, 0)::DOUBLE AS total_purchase_amount,
  coalesce(e, 0) AS recent_event_count, coalesce(c, 0) AS recent_click_count, coalesce(p, 0) AS recent_purchase_count, coalesce(a, 0) AS recent_total_purchase_amount,
  concat_ws(',', CASE WHEN event_count IS NULL THEN 'event_count' END, CASE WHEN click_count IS NULL THEN 'click_count' END, CASE WHEN purchase_count IS NULL THEN 'purchase_count' END, CASE WHEN total_purchase_amount IS NULL THEN 'total_purchase_amount' END) AS missing,
  (event_count IS NULL)::INT + (click_count IS NULL)::INT + (purchase_count IS NULL)::INT + (total_purchase_amount IS NULL)::INT AS n_missing, coalesce(active, 0) AS active
  FROM users u LEFT JOIN wide USING (user_id) LEFT JOIN rec USING (user_id))"""


def _asked(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct().union(events.sparkSession.sql("select '999999'"))


def _served(spark: SparkSession, d: str) -> DataFrame:
    events = table_events(spark, d)
    return ft.served_features(_asked(events), rd.user_features(events), rd.window_features(events, DAY), _recent(events))


@query(f"""WITH {_SERVED} SELECT user_id, event_count, click_count, purchase_count, total_purchase_amount, recent_event_count, recent_click_count, recent_purchase_count, recent_total_purchase_amount,
  missing, n_missing = 0 AS batch_features_available, active > 0 AS recent_activity_available, 5::BIGINT AS recent_windows_checked, active AS recent_windows_with_activity FROM srv""")
def serve_features(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, d).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {_SERVED} SELECT user_id, missing FROM srv WHERE n_missing > 0")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, d).where(F.size("missing") > 0).select("user_id", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {_SERVED} SELECT user_id, recent_event_count, recent_click_count, recent_purchase_count, recent_total_purchase_amount, active AS windows_with_activity FROM srv WHERE active > 0")
def recent_windows(spark: SparkSession, d: str) -> DataFrame:
    recent = [f"recent_{f}" for f in fn.BATCH_FEATURES]
    return _served(spark, d).where("recent_activity_available").select("user_id", *recent, F.col("recent_windows_with_activity").alias("windows_with_activity"))


_SCORED = f"""{_SERVED}, s1 AS (SELECT *, 1 / (1 + exp(-(-2.0::DOUBLE + {' + '.join(f'{w}::DOUBLE * {f}' for f, w in intent.WEIGHTS.items())}))) AS b,
  greatest(0.1::DOUBLE, least(1::DOUBLE, 1::DOUBLE - n_missing * 0.12::DOUBLE - CASE WHEN active = 0 THEN 0.2::DOUBLE ELSE 0 END)) AS c FROM srv),
  s2 AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, b * (c * 0.25::DOUBLE + 0.75::DOUBLE))) AS p FROM s1),
  scored AS (SELECT user_id, round(p, 4) AS purchase_probability, round(b, 4) AS base_probability, round(c, 4) AS confidence, CASE WHEN c < 0.5::DOUBLE THEN 'uncertain' WHEN p >= 0.7::DOUBLE THEN 'likely_to_purchase' WHEN p >= 0.35::DOUBLE THEN 'maybe_interested' ELSE 'low_intent' END AS label,
  concat_ws(',', CASE WHEN n_missing > 0 THEN 'missing_' || replace(missing, ',', ',missing_') END, CASE WHEN active = 0 THEN 'no_recent_stream_activity' END) AS warnings, missing FROM s2)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return intent.IntentModel().predict(_served(spark, d))


@query(f"WITH {_SCORED} SELECT user_id, purchase_probability, base_probability, confidence, label, warnings FROM scored")
def intent_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("user_id", "purchase_probability", "base_probability", "confidence", "label", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {_SCORED} SELECT count(*) AS prediction_count, round(avg(purchase_probability), 4) AS average_probability, round(avg(confidence), 4) AS average_confidence FROM scored")
def prediction_audit(spark: SparkSession, d: str) -> DataFrame:
    return intent.audit(_scored(spark, d))


@query(f"WITH {_SCORED} SELECT label, count(*) AS predictions FROM scored GROUP BY label")
def prediction_labels(spark: SparkSession, d: str) -> DataFrame:
    return intent.label_counts(_scored(spark, d))


@query(f"WITH {_SCORED} SELECT 'prediction:user:' || user_id || ':purchase_probability' AS key, CAST(purchase_probability AS VARCHAR) AS value FROM scored UNION ALL SELECT 'prediction:user:' || user_id || ':label', label FROM scored")
def prediction_cells(spark: SparkSession, d: str) -> DataFrame:
    return intent.prediction_cells(_scored(spark, d))


_FOUR = " || ',' || ".join(f"'feature:user:' || user_id || ':{f}'" for f in sql.FEATURES)


@query(f"""WITH {_SCORED}, wc AS ({sql.WINDOW_CELLS}), want AS (SELECT user_id, row_number() OVER () AS z, s, f, fi FROM (SELECT user_id FROM users) u, starts, (VALUES {', '.join(f"({k}, '{f}')" for k, f in enumerate(sql.FEATURES))}) v(fi, f)),
  rk AS (SELECT user_id, string_agg(key, ',' ORDER BY s, fi) AS r FROM (SELECT user_id, s, fi, 'feature:user:' || user_id || ':window:' || s || ':' || f AS key FROM want) WHERE key IN (SELECT key FROM wc) GROUP BY user_id)
  SELECT 'prediction_lineage' AS record_type, user_id, 'purchase-intent-v1' AS model_version, {_FOUR} || coalesce(',' || r, '') AS input_feature_keys,
  'prediction:user:' || user_id || ':purchase_probability,prediction:user:' || user_id || ':label' AS output_keys, missing AS missing_features, label FROM scored LEFT JOIN rk USING (user_id)""")
def prediction_lineage(spark: SparkSession, d: str) -> DataFrame:
    events = table_events(spark, d)
    cells = ft.as_cells(rd.window_features(events, DAY))
    rows = intent.prediction_lineage(_scored(spark, d), ft.served_keys(_asked(events), cells, _recent(events)))
    lists = [F.array_join(c, ",").alias(c) for c in ("input_feature_keys", "output_keys", "missing_features")]
    return rows.select("record_type", "user_id", "model_version", *lists, F.col("extra")["label"].alias("label"))


@query(f"WITH {sql.WIDE} SELECT 'total' AS scope, metric, value FROM (SELECT count(*)::DOUBLE AS users, sum(event_count)::DOUBLE AS events, round(sum(total_purchase_amount), 2) AS amount FROM wide) UNPIVOT (value FOR metric IN (users, events, amount))")
def experiment_metrics(spark: SparkSession, d: str) -> DataFrame:
    wide = rd.user_features(table_events(spark, d)).agg(F.count("*").alias("users"), F.sum("event_count").alias("events"), F.round(F.sum("total_purchase_amount"), 2).alias("amount"))
    return unpivoted(wide.withColumn("scope", F.lit("total")), ["scope"], ["users", "events", "amount"])


@query(f"WITH {sql.EV} SELECT pos, CASE lower(trim(x)) WHEN 'addtocart' THEN 'add_to_cart' WHEN 'transaction' THEN 'purchase' ELSE lower(trim(x)) END AS event_type FROM (SELECT pos, CASE pos % 3 WHEN 0 THEN ' ' || upper(event_type) WHEN 1 THEN 'AddToCart ' ELSE 'transaction' END AS x FROM ev)")
def normalize_event_types(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"))).when(F.col("pos") % 3 == 1, "AddToCart ").otherwise("transaction")
    return table_events(spark, d).select("pos", fn.normalize_event_type(raw).alias("event_type"))


@query(f"WITH {sql.EV} SELECT pos, user_id, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'click' END AS event_type, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE END AS amount FROM ev")
def to_batch_events(spark: SparkSession, d: str) -> DataFrame:
    buys = F.col("event_type") == "purchase"
    return table_events(spark, d).select("pos", "user_id", F.when(buys, "purchase").otherwise("click").alias("event_type"), F.when(buys, F.lit(1.0)).alias("amount"))


_REGISTRY = ", ".join(f"('{f.name}', '{f.key_pattern}', '{f.source}', '{f.value_type}', '{f.description}', '{','.join(f.used_by)}')" for f in DEFAULTS)


@query(f"SELECT * FROM (VALUES {_REGISTRY}) v(name, key_pattern, source, value_type, description, used_by)")
def feature_registry(spark: SparkSession, d: str) -> DataFrame:
    return Registry.default().table(spark).withColumn("used_by", F.array_join("used_by", ","))


@query(f"SELECT name, key_pattern FROM (VALUES {_REGISTRY}) v(name, key_pattern, source, value_type, description, used_by) WHERE source = 'stream'")
def registry_by_source(spark: SparkSession, d: str) -> DataFrame:
    return Registry.default().table(spark).where("source = 'stream'").select("name", "key_pattern").orderBy("name")
