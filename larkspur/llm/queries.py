"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import documents
from .licenses import PHRASES, TEMPLATES, THRESHOLD, license_scan
from .media import media_columns
from .mixing import MARKS, ROUNDS, TOLERANCE, WHITE, mixing_report
from .ngram_join import ngram_jaccard_join
from .pii import BONUS, CONTEXT, EDGE, FLAGGED, IBAN, KINDS, pii_scan
from .quality import quality
from .secrets import secret_scan
from .sharding import shard_by_bytes
from .toxicity import toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), shards=8)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir), size=4, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op6_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(documents(spark, sf_dir))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_sharding, op2_secret_scan, op3_ngram_jaccard_join, op4_toxicity, op5_license_scan,
        op6_pii_scan, op7_quality_rules, op8_media_columns, op9_mixing, op10_bpe_round_trip,
    ]
    return {f.__name__: f for f in own}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_sql() -> str:
    """Every block against every template by counting; no filters."""
    words = ", ".join(f"({k}, '{label}', '{w}', {len(set(t.split()))}, {len(t.split())})" for k, (label, t) in enumerate(TEMPLATES) for w in sorted(set(t.split())))
    at = lambda p: " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT rid, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: {at(p)})) AS k FROM w" for p, label in PHRASES.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents), w AS (SELECT rid, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
  pl AS ({places}), tw AS (SELECT * FROM (VALUES {words}) v(tid, label, word, size, step)),
  iw AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
  bw AS (SELECT rid, tid, label, size, word, i // step - back AS block FROM iw JOIN tw USING (word), (VALUES (0), (1)) o(back) WHERE i // step >= back),
  hit AS (SELECT rid, label, count(DISTINCT word)::DOUBLE / any_value(size) AS share FROM bw GROUP BY rid, tid, label, block HAVING 100 * count(DISTINCT word) >= {THRESHOLD} * any_value(size)),
  p AS (SELECT rid, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY rid),
  q AS (SELECT rid, max(share) AS share FROM hit GROUP BY rid), lb AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM pl UNION SELECT rid, label FROM hit) GROUP BY rid)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END, coalesce(share, 0::DOUBLE)) AS score FROM w LEFT JOIN p USING (rid) LEFT JOIN q USING (rid) LEFT JOIN lb USING (rid)"""


def mixing_sql(power: float = 0.8, rounds: int = ROUNDS, blocks: int = 4, seed: int = 17) -> str:
    """Raking unrolled: one common table for each margin of each round, and the largest error after each block of rounds.

    The weights are those of the first block whose error is within the tolerance (of the last one if none is).
    """
    times = lambda c: f"(strlen(t) - strlen(replace(t, chr({ord(c)}), '')))"
    margins = ("s", "l", "tp")
    goals = ", ".join(f"g_{m} AS MATERIALIZED (SELECT {m}, pow(b, {power}::DOUBLE) / sum(pow(b, {power}::DOUBLE)) OVER () AS g FROM (SELECT {m}, sum(base)::DOUBLE AS b FROM cells GROUP BY {m} HAVING sum(base) > 0))" for m in margins)
    steps, last, ends = ["w0 AS (SELECT *, base::DOUBLE AS w FROM cells)"], 0, []
    for _ in range(blocks):
        for _ in range(rounds):
            for m in margins:
                steps.append(f"w{last + 1} AS {'MATERIALIZED ' if m == margins[-1] else ''}(SELECT s, l, tp, base, w * CASE WHEN now > 0 THEN coalesce(g, 0) * total / now ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS now FROM w{last}) LEFT JOIN g_{m} USING ({m}), total)")
                last += 1
        ends.append(last)
        off = " UNION ALL ".join(f"SELECT max(abs(now / (g * total) - 1)) AS x FROM (SELECT {m}, sum(w) AS now FROM w{last} GROUP BY {m}) JOIN g_{m} USING ({m}), total WHERE g > 0" for m in margins)
        steps.append(f"e{last} AS MATERIALIZED (SELECT max(x) AS x FROM ({off}))")
    pick = "CASE " + " ".join(f"WHEN (SELECT x FROM e{k}) <= {TOLERANCE} THEN w{k}.w" for k in ends[:-1]) + f" ELSE w{ends[-1]}.w END"
    joined = f"w{ends[0]} " + " ".join(f"JOIN w{k} USING (s, l, tp)" for k in ends[1:])
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, coalesce(text, '') AS t FROM documents),
  c AS (SELECT doc_id, s, l, CASE WHEN t = '' THEN 0 ELSE {' + '.join(map(times, WHITE))} + 1 END AS n, {times('|')} AS bars, {' + '.join(map(times, MARKS))} AS marks, {times('!')} AS bangs FROM d),
  r AS (SELECT doc_id, s, l, n, CASE WHEN bars * 4 > n THEN 'table' WHEN marks * 4 > n THEN 'marked' WHEN bangs * 4 > n THEN 'loud' WHEN n < 100 THEN 'note' WHEN n > 1000 THEN 'long' ELSE 'prose' END AS tp FROM c),
  cells AS MATERIALIZED (SELECT s, l, tp, sum(n) AS base FROM r GROUP BY ALL), total AS MATERIALIZED (SELECT sum(base)::DOUBLE AS total FROM cells), {goals}, {', '.join(steps)},
  f AS MATERIALIZED (SELECT s, l, tp, w{ends[0]}.base AS base, {pick} AS w FROM {joined}),
  z AS (SELECT s, l, tp, w, CASE WHEN base > 0 THEN (w / base) / max(CASE WHEN base > 0 THEN w / base ELSE 0 END) OVER () ELSE 1 END AS p FROM f)
  SELECT doc_id, s AS source, l AS lang, tp AS topic, n::BIGINT AS tokens, round(w, 4) AS weight, round(p, 6) AS probability,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '(none)') || ':{seed}'), 1, 13))::BIGINT / {16**13}::DOUBLE < p AS kept FROM r JOIN z USING (s, l, tp)"""


#: The plain patterns of personal data, and what an account number is among the runs of letters and digits.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": "[A-Za-z0-9]+",
}


def pii_sql() -> str:
    """Places by the lengths of what lies between the matches; checksums digit by digit."""
    kinds = (*KINDS, IBAN)
    numbered = {k.name: n for n, k in enumerate(kinds)}
    found = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for k, p in _PLAIN.items())
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) * (2 - i % 2)) // 10 + (CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) * (2 - i % 2)) % 10)) % 10 = 0"
    number = "array_to_string(list_transform(regexp_extract_all(substr(hit, 5) || substr(hit, 1, 4), '.'), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod97 = f"list_reduce(list_transform(regexp_extract_all('0' || {number}, '.'), lambda c: CAST(c AS INT)), lambda a, x: (a * 10 + x) % 97) = 1"
    valid = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || ltrim(x, '0') AS HUGEINT) <= 255))",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15", "iban": mod97,
    }
    case = lambda x: "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {x(k)}" for k in kinds) + " END"
    before = f"right(coalesce(right(' ' || substr(t, ppb + 1, pa - ppb), {CONTEXT}), '') || right(' ' || substr(t, pb + 1, a - pb), {CONTEXT}), {CONTEXT})"
    after = f"left(left(substr(t, b + 1, na - b) || ' ', {CONTEXT}) || coalesce(left(substr(t, nb + 1, nna - nb) || ' ', {CONTEXT}), ''), {CONTEXT})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
  x AS (SELECT rid, kind, unnest(h) AS hit, generate_subscripts(h, 1) AS i, unnest(list_transform(g[1:len(h)], lambda z: length(z))) AS gl FROM m),
  s AS (SELECT rid, kind, hit, CAST(sum(gl + length(hit)) OVER w - length(hit) AS BIGINT) AS a, CAST(sum(gl + length(hit)) OVER w AS BIGINT) AS b FROM x WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
  f AS (SELECT * FROM s WHERE kind <> 'iban' OR regexp_full_match(hit, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}')),
  n AS (SELECT f.*, coalesce(lag(b) OVER v, 0) AS pb, lag(a) OVER v AS pa, CASE WHEN lag(a) OVER v IS NOT NULL THEN coalesce(lag(b, 2) OVER v, 0) END AS ppb,
    coalesce(lead(a) OVER v, (SELECT length(t) FROM d WHERE d.rid = f.rid)) AS na, lead(b) OVER v AS nb, CASE WHEN lead(b) OVER v IS NOT NULL THEN coalesce(lead(a, 2) OVER v, (SELECT length(t) FROM d WHERE d.rid = f.rid)) END AS nna
    FROM f WINDOW v AS (PARTITION BY rid, kind ORDER BY a)),
  c AS (SELECT n.*, {_LOWER.format(f"{before} || ' ' || {after}")} AS ctx, {case(lambda k: numbered[k.name])} AS o FROM n JOIN d USING (rid)),
  e AS (SELECT rid, kind, o, a, b, least(1::DOUBLE, {case(lambda k: f"{k.score}::DOUBLE")} + CASE WHEN {case(lambda k: f"regexp_matches(ctx, '{EDGE}(?:{k.words}){EDGE}')")} THEN {BONUS}::DOUBLE ELSE 0 END) AS score
    FROM c WHERE {case(lambda k: valid[k.name])}),
  r AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in kinds)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) FILTER (kind <> 'iban') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) AS spans,
    max(score) AS score, count(*) FILTER (score >= {FLAGGED}::DOUBLE) AS n_flagged FROM e GROUP BY rid)
  SELECT doc_id, {', '.join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0::DOUBLE) AS score, coalesce(n_flagged, 0) AS n_flagged FROM d LEFT JOIN r USING (rid)"""


def join_sql(size: int = 4, percent: int = 85) -> str:
    """All pairs of documents by their common shingles, and the smallest document reachable."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
  e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS v, b AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
  SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c.m, doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(u) AS m FROM r GROUP BY v) c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express at the size of whole tables.

    The others have brute-force versions in their tests: SQL has no CRC-32 (1), trained models and fields (2, 4, 7), MPEG
    frames (8) or merges (10).
    """
    return {"op3_ngram_jaccard_join": join_sql(), "op5_license_scan": license_sql(), "op6_pii_scan": pii_sql(), "op9_mixing": mixing_sql()}
