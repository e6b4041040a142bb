"""Document quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

A rule votes good (+1), bad (-1) or abstains (0). Expectation-maximisation runs over the counts of vote patterns, of
which there are at most 3 ** len(RULES) whatever the number of documents, and estimates the share of good documents and
how each rule votes on good and on bad ones. The posterior of a document's pattern replaces an all-must-pass filter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import shingles, word_hashes
from .common import checkpoint, map_arrow, narrow, texts

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def counts(text: str) -> dict[str, int]:
    """What the rules look at."""
    words = word_hashes(text.encode())
    n = len(words)
    repeated = 0
    if n >= 3:
        _, at, times = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        starts = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= starts
        repeated = int(covered.sum())
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            again += line in seen
            seen.add(line)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, WHITE)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": again, "n_repeat_words": repeated, "n_lines": lines,
        "n_upper": int(raw[65:91].sum()), "n_letters": int(raw[65:91].sum() + raw[97:123].sum()),
        "n_shouts": text.count("!!"), "n_stops": sum(map(text.count, ".,;?!")),
    }


def share(c: dict, part: str, whole: str = "n_words") -> float:
    return c[part] / max(1, c[whole])


def defect(found: Callable[[dict], bool]) -> Callable[[dict], int]:
    """A rule that knows one kind of junk: it votes bad or abstains."""
    return lambda c: -1 if found(c) else 0


def merit(found: Callable[[dict], bool]) -> Callable[[dict], int]:
    return lambda c: 1 if found(c) else 0


RULES: dict[str, Callable[[dict], int]] = {
    "short": defect(lambda c: c["n_words"] < 50),
    "symbols": defect(lambda c: share(c, "n_symbols") > 0.1),
    "lines": defect(lambda c: share(c, "n_dup_lines", "n_lines") > 0.5),
    "repeats": defect(lambda c: share(c, "n_repeat_words") > 0.4),
    "word_size": defect(lambda c: not 2.5 <= share(c, "word_chars") <= 14),
    "capitals": defect(lambda c: share(c, "n_upper", "n_letters") > 0.5),
    "shouts": defect(lambda c: share(c, "n_shouts") > 0.05),
    "long": merit(lambda c: c["n_words"] >= 80),
    "plain": merit(lambda c: share(c, "n_symbols") < 0.02 and share(c, "n_upper", "n_letters") < 0.2 and not c["n_shouts"]),
    "fluent": merit(lambda c: 0.02 < share(c, "n_stops") < 0.5 and share(c, "n_repeat_words") < 0.1),
}


def estimate(votes: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior probability of good for each pattern (rows of -1, 0, 1), the prior, and each rule's chance of voting
    -1, 0 and 1 on bad and on good documents (axes: class, rule, vote).

    It starts from "any bad vote means bad". A rule's bad vote never counts as evidence of good, nor its good vote as
    evidence of bad, so the classes can't swap. No documents give the prior 0.5.
    """
    posterior = np.where((votes < 0).any(1), 0.1, 0.9)
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    prior, chance = 0.5, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for y, p in ((0, weights * (1 - posterior)), (1, weights * posterior)):
            chance[y] = (np.einsum("p,prv->rv", p, cast) + [0.1, 1, 0.1]) / (p.sum() + 1.2)
        prior = float(np.clip((weights @ posterior + 1) / (weights.sum() + 2), 0.05, 0.95))
        ratio = np.log(chance[1]) - np.log(chance[0])
        ratio = np.stack([np.minimum(ratio[:, 0], 0), ratio[:, 1], np.maximum(ratio[:, 2], 0)], 1)
        odds = np.einsum("prv,rv->p", cast, ratio) + np.log(prior) - np.log1p(-prior)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return posterior, prior, chance


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes, p_quality.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not base_failed and a posterior
    of at least the threshold. One row out for each row in; a null text has no words. Other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counts(t) for t in texts(batch)]
        votes = ["".join("-0+"[rule(c) + 1] for rule in RULES.values()) for c in found]
        arrays = [batch.column("doc_id"), *[pa.array([c[k] for c in found], pa.int64()) for k in names], pa.array(votes)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "votes"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names) + ", votes string"
    voted = checkpoint(map_arrow(narrow(docs, "doc_id", "text"), run, schema))
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()
    matrix = np.array([["-0+".index(v) - 1 for v in row.votes] for row in patterns], int).reshape(len(patterns), len(RULES))
    posterior, _, _ = estimate(matrix, np.array([row["count"] for row in patterns], float))
    of = docs.sparkSession.createDataFrame([(row.votes, float(p)) for row, p in zip(patterns, posterior, strict=True)], "votes string, p_quality double")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    joined = voted.join(F.broadcast(of), "votes", "left").withColumn("base_failed", failed)
    return joined.select("doc_id", *names, "base_failed", (~F.col("base_failed") & (F.col("p_quality") >= threshold)).alias("kept"), "votes", "p_quality")
