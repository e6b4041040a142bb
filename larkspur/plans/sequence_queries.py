"""Queries over ordered histories and the attention scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attention as at
from ..operators import sequences as sq
from ..sources.events import sample_events, table_events
from ..sources.shared import written
from . import sql
from .registry import query

MODEL = at.AttentionModel()

_SEQ = f"""{sql.EV}, ord AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, pos) AS rn, min(pos) OVER (PARTITION BY user_id) AS user_first FROM ev),
  ex AS (SELECT pos, user_id, user_first, t, rn, (event_type = 'purchase')::INT AS label, event_type, item_id FROM ord WHERE rn > 1),
  hist AS (SELECT x.pos, x.user_id, x.user_first, x.t, x.label, 2 * (h.rn - greatest(x.rn - 10, 1)) AS k, h.event_type, coalesce(h.item_id, 'None') AS item_id FROM ex x JOIN ord h ON h.user_id = x.user_id AND h.rn BETWEEN x.rn - 10 AND x.rn - 1),
  tok AS (SELECT pos, user_id, user_first, t, label, k, 'event:' || event_type AS token FROM hist UNION ALL SELECT pos, user_id, user_first, t, label, k + 1, 'item:' || item_id FROM hist)"""

_VOCAB = f"""{_SEQ}, voc AS (SELECT token, CAST(row_number() OVER (ORDER BY user_first, t, pos, k) + 1 AS INTEGER) AS id FROM (SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY token ORDER BY user_first, t, pos, k) = 1))"""

_SPLIT = """spl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY user_id, t, pos) <= CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE)) ELSE 0 END AS is_test FROM ex)"""

_ATT = f"""{_VOCAB}, cnt AS (SELECT pos, count(*) AS n FROM tok GROUP BY pos), step AS (SELECT tok.pos, tok.label, tok.token, voc.id, CAST(20 - n + k AS INTEGER) AS plc FROM tok JOIN cnt USING (pos) JOIN voc USING (token)),
  base AS (SELECT id, d, ('0x' || substr(sha256(id || ':' || d), 1, 8))::BIGINT / 4294967295::DOUBLE * 2 - 1 AS b FROM voc, range(16) r(d)), place AS (SELECT CAST(p AS INTEGER) AS plc, d, sin((p + 1) / pow(10000::DOUBLE, d / 16::DOUBLE)) AS s FROM range(20) a(p), range(16) r(d)),
  emb AS (SELECT step.*, base.d, b * 0.85::DOUBLE + s * 0.15::DOUBLE AS v FROM step JOIN base USING (id) JOIN place USING (plc, d)),
  pnt AS (SELECT e.pos, e.plc, sum(e.v * q.v) / 4 + e.plc * 0.03::DOUBLE AS x FROM emb e JOIN emb q ON q.pos = e.pos AND q.d = e.d AND q.plc = 19 GROUP BY e.pos, e.plc),
  wt AS (SELECT pos, plc, exp(x - max(x) OVER (PARTITION BY pos)) AS u FROM pnt), att AS (SELECT step.*, u / sum(u) OVER (PARTITION BY pos) AS w FROM wt JOIN step USING (pos, plc))"""

_FIT = f"""{_ATT}, {_SPLIT}, ctx AS (SELECT pos, d, sum(w * v) AS c FROM att JOIN emb USING (pos, plc) GROUP BY pos, d),
  wvec AS (SELECT d, (avg(c) FILTER (label = 1) - avg(c) FILTER (label = 0)) * 0.75::DOUBLE AS w FROM ctx JOIN spl USING (pos) WHERE NOT is_test GROUP BY d),
  rate AS (SELECT avg(label) AS r, ln(greatest(0.01::DOUBLE, least(0.99::DOUBLE, avg(label))) / (1 - greatest(0.01::DOUBLE, least(0.99::DOUBLE, avg(label))))) AS bias FROM spl WHERE NOT is_test),
  ts AS (SELECT token, avg(label) AS score FROM (SELECT DISTINCT tok.pos, tok.token, spl.label FROM tok JOIN spl USING (pos) WHERE NOT is_test) GROUP BY token)"""

_PRED = f"""{_FIT}, sig AS (SELECT pos, 6 * sum(round(w, 4) * (coalesce(score, r) - r)) AS s FROM att LEFT JOIN ts USING (token), rate GROUP BY pos), lin AS (SELECT pos, sum(c * w) AS l FROM ctx JOIN wvec USING (d) GROUP BY pos),
  beh AS (SELECT pos, max((token = 'event:add_to_cart')::INT) * 0.9::DOUBLE + max((token = 'event:purchase')::INT) * 1.2::DOUBLE + CASE WHEN count(*) FILTER (token = 'event:view') >= 3 THEN 0.25::DOUBLE ELSE 0 END AS b FROM step WHERE plc >= 12 GROUP BY pos),
  raw AS (SELECT pos, 1 / (1 + exp(-(bias + l + s + b))) AS p FROM sig JOIN lin USING (pos) JOIN beh USING (pos), rate), prd AS (SELECT pos, user_id, label AS truth, p, greatest(0.1::DOUBLE, least(1::DOUBLE, abs(p - 0.5::DOUBLE) + 0.45::DOUBLE + 0.25::DOUBLE)) AS c FROM raw JOIN spl USING (pos) WHERE is_test),
  pred AS (SELECT pos, user_id, truth, round(p, 4) AS purchase_probability, round(c, 4) AS confidence, CASE WHEN c < 0.45::DOUBLE THEN 'uncertain' WHEN p >= 0.65::DOUBLE THEN 'likely_to_purchase' WHEN p >= 0.4::DOUBLE THEN 'maybe_interested' ELSE 'low_intent' END AS label FROM prd)"""


@query(f"WITH {sql.EV} SELECT user_id, count(*) AS events, string_agg(event_type || '@' || t, ',' ORDER BY t, pos) AS history FROM ev GROUP BY user_id")
def user_histories(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("history", lambda e: F.concat_ws("@", e.event_type, e.timestamp.cast("string")))
    return sq.histories(table_events(spark, d)).select("user_id", F.size("history").cast("bigint").alias("events"), F.array_join(shown, ",").alias("history"))


@query(f"WITH {_SEQ} SELECT pos, user_id, label, string_agg(token, ',' ORDER BY k) AS tokens FROM tok GROUP BY ALL")
def sequence_examples(spark: SparkSession, d: str) -> DataFrame:
    return sq.examples(table_events(spark, d)).select("pos", "user_id", "label", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {_VOCAB} SELECT token, id FROM voc UNION ALL VALUES ('<PAD>', 0), ('<UNK>', 1)")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return sq.vocabulary(sq.examples(table_events(spark, d)))


@query(f"WITH {_VOCAB}, cnt AS (SELECT pos, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS ids FROM tok JOIN voc USING (token) GROUP BY pos) SELECT pos, repeat('0,', CAST(20 - n AS INTEGER)) || ids AS ids FROM cnt")
def encoded_sequences(spark: SparkSession, d: str) -> DataFrame:
    found = sq.examples(table_events(spark, d))
    return sq.encoded(found, sq.vocabulary(found)).select("pos", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {_VOCAB} SELECT v.id, coalesce(token, '<UNK>') AS token FROM (SELECT CAST(i AS INTEGER) AS id FROM range(2, (SELECT max(id) + 4 FROM voc)) r(i)) v LEFT JOIN voc USING (id)")
def decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    vocab = sq.vocabulary(sq.examples(table_events(spark, d)))
    beyond = vocab.agg(F.max("id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + 3)).alias("id"))  # ids that are no token's
    return sq.decoded(vocab.where("id > 1").select("id").union(beyond), vocab).select("id", "token")


@query(f"WITH {_SEQ}, {_SPLIT} SELECT pos, label, is_test FROM spl")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sq.stratified_split(sq.examples(table_events(spark, d))).select("pos", "label", "is_test")


@query(f"WITH {_SEQ} SELECT pos, row_number() OVER (ORDER BY user_first, t, pos) > greatest(1, floor((SELECT count(*) FROM ex) * 0.7::DOUBLE)) AS is_test FROM ex")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = sq.prefix_split(sq.examples(table_events(spark, d)))
    return train.select("pos", F.lit(False).alias("is_test")).union(test.select("pos", F.lit(True)))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = written(sq.examples(table_events(spark, d)))
    split = written(sq.stratified_split(found))
    return split.where("not is_test"), split.where("is_test"), written(sq.vocabulary(found))


@query(f"WITH {_SEQ} SELECT token, round(avg(label), 4) AS score FROM (SELECT DISTINCT pos, token, label FROM tok) GROUP BY token")
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    found = sq.examples(table_events(spark, d))
    return found.select("label", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.round(F.avg("label"), 4).alias("score"))


@query(f"WITH {_SEQ} SELECT round(avg(label), 4) AS positive_rate, count(*) AS examples FROM ex")
def positive_rate(spark: SparkSession, d: str) -> DataFrame:
    return sq.examples(table_events(spark, d)).agg(F.round(F.avg("label"), 4).alias("positive_rate"), F.count("*").alias("examples"))


@query(f"""WITH {_VOCAB} SELECT i AS id, CAST(p AS INTEGER) AS position, CAST(d AS INTEGER) AS dim, round(0.85::DOUBLE * (('0x' || substr(sha256(i || ':' || d), 1, 8))::BIGINT / 4294967295::DOUBLE * 2 - 1) + 0.15::DOUBLE * sin((p + 1) / pow(10000::DOUBLE, d / 16::DOUBLE)), 6) AS value
  FROM (SELECT id AS i FROM voc UNION ALL SELECT 1) a, range(20) b(p), range(16) c(d)""")
def token_embeddings(spark: SparkSession, d: str) -> DataFrame:
    vocab = sq.vocabulary(sq.examples(table_events(spark, d)))
    grid = vocab.where("id > 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("position"))
    vector = at.embedding(at.base_vector(F.col("id"), 16), F.col("position"), 16)
    return grid.select("id", "position", F.posexplode(vector).alias("dim", "v")).select("id", "position", "dim", F.round("v", 6).alias("value"))


def _attended(spark: SparkSession, d: str) -> DataFrame:
    found = written(sq.examples(table_events(spark, d)))
    return MODEL.attended(found, written(sq.vocabulary(found)))


@query(f"WITH {_ATT} SELECT pos, plc AS position, id, token, round(w, 4) AS attention FROM att")
def attention_weights(spark: SparkSession, d: str) -> DataFrame:
    return _attended(spark, d).select("pos", F.inline("steps")).select("pos", F.col("at").alias("position"), "id", "token", "attention")


@query(f"WITH {_ATT} SELECT pos, token, plc AS position, round(w, 4) AS attention FROM att QUALIFY row_number() OVER (PARTITION BY pos ORDER BY round(w, 4) DESC, plc) <= 5")
def attention_top5(spark: SparkSession, d: str) -> DataFrame:
    return _attended(spark, d).select("pos", F.inline(at.top_tokens(F.col("steps"))))


@query(f"WITH {_FIT} SELECT CAST(d AS INTEGER) AS dim, round(w, 6) AS weight, round(bias, 6) AS bias FROM wvec, rate")
def seq_fit(spark: SparkSession, d: str) -> DataFrame:
    train, _, vocab = _parts(spark, d)
    fitted = MODEL.fit(train, vocab)
    return spark.createDataFrame([(k, w, fitted.bias) for k, w in enumerate(fitted.weight)], "dim int, weight double, bias double").select("dim", F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    train, test, vocab = _parts(spark, d)
    return MODEL.predict(test, vocab, MODEL.fit(train, vocab))


@query(f"WITH {_PRED} SELECT pos, user_id, purchase_probability, confidence, label FROM pred")
def seq_predict(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).select("pos", "user_id", "purchase_probability", "confidence", "label")


@query(f"""WITH {_PRED}, m AS (SELECT count(*) FILTER (truth = 1 AND g = 1) AS tp, count(*) FILTER (truth = 0 AND g = 0) AS tn, count(*) FILTER (truth = 0 AND g = 1) AS fp, count(*) FILTER (truth = 1 AND g = 0) AS fn, count(*) AS n FROM (SELECT *, (purchase_probability >= 0.5::DOUBLE)::INT AS g FROM pred)),
  q AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS p, tp / greatest(1, tp + fn)::DOUBLE AS r FROM m) SELECT round((tp + tn) / greatest(1, n)::DOUBLE, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / greatest(0.000001::DOUBLE, p + r), 4) AS f1, tp, tn, fp, fn FROM q""")
def seq_metrics(spark: SparkSession, d: str) -> DataFrame:
    return at.evaluate(_predicted(spark, d))


@query("SELECT * FROM (VALUES (0.6667::DOUBLE, 0.3333::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 1::BIGINT, 3::BIGINT, 2::BIGINT, 0::BIGINT)) v(accuracy, precision, recall, f1, tp, tn, fp, fn)")
def sample_sequence_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The sample history, split, fitted and evaluated; the SQL holds the known figures."""
    found = sq.stratified_split(sq.examples(sample_events(spark)))
    vocab = sq.vocabulary(found)
    return at.evaluate(MODEL.predict(found.where("is_test"), vocab, MODEL.fit(found.where("not is_test"), vocab)))
