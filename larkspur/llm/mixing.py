"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling. Native.

Documents fall into cells of source, language and topic. Fitting rakes the cells' tokens to target shares of each margin
in turn until all hold; a cell's fitted over its present tokens is its documents' sampling weight, and the weights divided
by the largest one are their probabilities. So the expected tokens of the sample stand in the target proportions.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch

DIMENSIONS = ("source", "lang", "topic")
#: Cells that may be broadcast to the documents; beyond, Spark joins them in its own way.
BROADCAST_CELLS = 10_000
NONE = "(none)"
#: What parts tokens, and the symbols of marked-up text.
WHITE, MARKS = " \t\n", "#$%&*"
#: Raking goes on until no margin is off by more than this share of it, or as long as ROUNDS more rounds help.
TOLERANCE, ROUNDS = 1e-6, 5


def times(char: str) -> Column:
    """How often an ASCII character stands in mix_text."""
    return (F.octet_length("mix_text") - F.octet_length(F.replace(F.col("mix_text"), F.lit(char), F.lit("")))).cast("bigint")


def celled(docs: DataFrame) -> DataFrame:
    """The table with mix_source, mix_lang, mix_topic and mix_tokens; null sources and languages are one value.

    Tokens are a text's spaces, tabs and line ends plus one, and none without text. The topic is its form: table, marked
    (symbols), loud (exclamations), note (short), long or prose.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    named = [F.coalesce(docs[c].cast("string"), F.lit(NONE)).alias(f"mix_{c}") for c in ("source", "lang")]
    rows = docs.select("*", *named, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("mix_text"))
    marks = sum((times(c) for c in MARKS[1:]), times(MARKS[0]))
    white = sum((times(c) for c in WHITE[1:]), times(WHITE[0]))
    counted = rows.select(*docs.columns, "mix_source", "mix_lang", F.when(F.col("mix_text") == "", 0).otherwise(white + 1).cast("bigint").alias("mix_tokens"), times("|").alias("mix_bars"), marks.alias("mix_marks"), times("!").alias("mix_bangs"))
    n = F.col("mix_tokens")
    topic = (
        F.when(F.col("mix_bars") * 4 > n, "table").when(F.col("mix_marks") * 4 > n, "marked").when(F.col("mix_bangs") * 4 > n, "loud")
        .when(n < 100, "note").when(n > 1000, "long").otherwise("prose")
    )
    return counted.select(*docs.columns, "mix_source", "mix_lang", topic.alias("mix_topic"), "mix_tokens")


def smoothed(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a margin: its present shares to a power below 1, which lifts the small ones."""
    sums = cells.groupBy(dimension).agg(F.sum("base").alias("total")).where("total > 0")
    whole = sums.agg(F.sum(F.pow("total", F.lit(power))).alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select(dimension, (F.pow("total", F.lit(power)) / F.col("whole")).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (dimensions, base) -> with weight, whose margins are the targets (dimension, target) of the total.

    Values of a margin without a target get weight 0. The targets are joined to the cells once; each step then divides by
    sums over windows of one margin, so a round is three small shuffles and no join. After every `rounds` rounds the margins
    are compared with their targets. Where no weights of these cells meet all targets (say, if each source has a language of
    its own), raking ends once the largest error no longer falls by a tenth: the last margin holds, the others as nearly as
    they got, and a warning names the error.
    """
    goals = {d: f"mix_goal_{d}" for d in targets}
    total = F.broadcast(cells.agg(F.sum("base").cast("double").alias("mix_total")))
    out = cells.withColumn("weight", F.col("base").cast("double")).crossJoin(total)  # one row
    for d, target in targets.items():
        out = out.join(target.select(d, F.col("target").alias(goals[d])), d, "left").withColumn(goals[d], F.coalesce(F.col(goals[d]) * F.col("mix_total"), F.lit(0.0)))
    out = checkpoint(out.drop("mix_total"))
    before = float("inf")
    while True:
        for _ in range(rounds):
            for d, goal in goals.items():
                now = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(now > 0, F.col("weight") * (F.col(goal) / now)).otherwise(0.0))
        out = checkpoint(out)
        off = [out.where(F.col(goal) > 0).groupBy(d).agg((F.abs(F.sum("weight") / F.first(goal) - 1)).alias("off")).select("off") for d, goal in goals.items()]
        worst = reduce(DataFrame.union, off).agg(F.max("off").alias("off")).first().off or 0.0
        if worst <= tolerance or worst > 0.9 * before:
            break
        before = worst
    if worst > tolerance:
        warnings.warn(f"no weights meet all targets: a margin is off by a share of {worst:.3g}", stacklevel=2)
    return out.drop(*goals.values())


def mixing_weights(rows: DataFrame, power: float = 0.8, rounds: int = ROUNDS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """From celled rows, one row for each cell: source, lang, topic, base (tokens), weight (fitted tokens), probability."""
    names = [f"mix_{d}" for d in DIMENSIONS]
    cells = rows.groupBy(*names).agg(F.sum("mix_tokens").alias("base"))
    cells = checkpoint(cells.select(*[F.col(n).alias(d) for n, d in zip(names, DIMENSIONS, strict=True)], "base"))
    goals = {d: (targets or {}).get(d) or checkpoint(smoothed(cells, d, power)) for d in DIMENSIONS}
    raked = rake(cells, goals, rounds).withColumn("ratio", F.expr("if(base > 0, weight / base, 0D)"))
    most = float(raked.agg(F.max("ratio").alias("m")).first().m or 0)
    share = F.col("ratio") / F.lit(most) if most > 0 else F.lit(0.0)
    return raked.select(*DIMENSIONS, "base", "weight", F.when(F.col("base") > 0, share).otherwise(1.0).alias("probability"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the doc_id and the seed decide; null ids share one."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit(NONE)), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def sampled(rows: DataFrame, power: float, rounds: int, seed: int, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Celled rows with mix_weight (of their cell), mix_probability and mix_kept."""
    with scratch(rows.sparkSession):
        cells = mixing_weights(rows, power, rounds, targets)
        cells = checkpoint(cells.select(*[F.col(d).alias(f"mix_{d}") for d in DIMENSIONS], F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability")), out=True)
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    out = rows.join(cells, [f"mix_{d}" for d in DIMENSIONS])
    return out.withColumn("mix_kept", draw(F.col("doc_id"), seed) < F.col("mix_probability"))


def mix(docs: DataFrame, power: float = 0.8, rounds: int = ROUNDS, seed: int = 17, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table's rows with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight (of its cell), mix_probability, mix_kept.

    One row out for each row in. Null sources and languages are one value each; a cell without tokens is kept whole.
    Rows that repeat a doc_id are kept or dropped alike within a cell, and so are all rows without one. Texts of any
    length count whole. Columns of the table named mix_... are replaced, others stay. An empty table gives an empty result.
    """
    out = sampled(celled(docs), power, rounds, seed, targets)
    return out.select(*[c for c in docs.columns if not c.startswith("mix_")], *[f"mix_{c}" for c in ("source", "lang", "topic", "tokens", "weight", "probability", "kept")])


def mixing_report(docs: DataFrame, power: float = 0.8, rounds: int = ROUNDS, seed: int = 17) -> DataFrame:
    """Columns doc_id, source, lang, topic, tokens, weight (4 decimals), probability (6), kept of every row. Texts are read once."""
    slim = checkpoint(celled(docs.select("doc_id", "text", "source", "lang")).drop("text", "source", "lang"))
    names = ("source", "lang", "topic", "tokens", "weight", "probability", "kept")
    digits = {"weight": 4, "probability": 6}
    return sampled(slim, power, rounds, seed).select("doc_id", *[(F.round(f"mix_{c}", digits[c]) if c in digits else F.col(f"mix_{c}")).alias(c) for c in names])
