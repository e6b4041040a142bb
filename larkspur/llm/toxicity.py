"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the hashed embeddings of the word and of its first 4 to 9 bytes, so that unseen
forms of a known stem are understood; buckets that training never saw are zero. Filters of widths 1, 2 and 3 slide over
the whole text, each is max-pooled, and a logistic layer scores the pooled values. Before gradient descent, one embedding
dimension holds each bucket's smoothed log ratio of toxic to clean training documents, and one filter reads it.

Training sees a bounded sample of the rows that aren't held out (at most MAX_TRAIN documents of each label and MAX_BYTES
of text); one in CALIBRATE of it is kept from the weights, and calibrates the cut and each language's threshold. Scoring
sees every document whole. A score depends on the text alone.

Many texts are scored at once: their distinct words are looked up once, and windows never cross from a text to the next.
A very long text is scored in pieces that share their border words, with the same result for every size of piece.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import map_arrow, narrow, raw_texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 12, (1, 2, 3), 4
PREFIXES = (4, 5, 6, 7, 8, 9)
SLOTS = 1 + len(PREFIXES)
#: Training documents of each label, and bytes of text of each, at most. Documents are taken in the order of a hash of their id.
MAX_TRAIN, MAX_BYTES = 2000, 32 << 20
#: One training document in so many calibrates instead, where each label has at least LEAST_OF_LABEL of these.
CALIBRATE, LEAST_OF_LABEL = 4, 10
EPOCHS, BATCH, RATE = 6, 16, 0.05
#: Calibrated thresholds stay between these.
LOWEST, HIGHEST = 0.3, 0.8
#: Documents of each label that a language needs for a threshold of its own.
LEAST_OF_LANGUAGE = 10
#: Bytes of text that are scored at once; longer texts are cut at words.
PIECE = 1 << 18
BORDER = max(WIDTHS) - 1


def _columns() -> list[tuple[int, int, int]]:
    """(width, offset in the window, first column) of each block of FILTERS columns of the projection."""
    return [(w, j, FILTERS * k) for k, (w, j) in enumerate((w, j) for w in WIDTHS for j in range(w))]


COLUMNS = _columns()


def word_buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of the words of a lower-cased buffer (words x SLOTS; BUCKETS stands for none)."""
    out = np.full((len(starts), SLOTS), BUCKETS, np.int32)
    if not len(starts):
        return out
    mask = np.uint64(BUCKETS - 1)
    out[:, 0] = bw.hash_spans(buf, starts, ends) & mask
    lengths, total = ends - starts, np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        total += bw._BYTE[buf[np.minimum(starts + k, len(buf) - 1)]] * bw.powers(16)[k]
        if k + 1 in PREFIXES:
            long = lengths > k
            out[long, 1 + PREFIXES.index(k + 1)] = (bw.mix(total[long] + np.uint64(k)) & mask).astype(np.int32)
    return out


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of the distinct words of some texts, and each text as the row numbers of its words."""
    ids: dict[int, int] = {}
    table, held = [np.zeros((0, SLOTS), np.int32)], []
    for text in texts:
        buf = bw.LOWER[np.frombuffer(text, np.uint8)]
        starts, ends = bw.spans(buf, bw.NOT_WORD)
        hashes, first, inverse = np.unique(bw.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        new = np.sort(first[[h not in ids for h in hashes.tolist()]]) if len(first) else first
        buckets = word_buckets(buf, starts[new], ends[new])
        for h in bw.hash_spans(buf, starts[new], ends[new]).tolist():
            ids[h] = len(ids)
        table.append(buckets)
        held.append(np.array([ids[h] for h in hashes.tolist()], np.int32)[inverse])
    return np.concatenate(table), held


def evened(part: np.ndarray, none: int = BUCKETS) -> np.ndarray:
    """Short words fill fewer slots; this makes up for it."""
    return (SLOTS / np.maximum(1, (part != none).sum(-1, keepdims=True))).astype(np.float32)


def convolved(z: np.ndarray) -> list[np.ndarray]:
    """From the filters' parts of every row (BORDER rows of zeros end each text), each width's windows, as far as they fit."""
    n = len(z) - BORDER
    return [sum(z[j : j + n, c : c + FILTERS] for width, j, c in COLUMNS if width == w) for w in WIDTHS]


@dataclass
class Scorer:
    """What scoring needs: the filters' parts of each bucket that training saw, and the layer above."""

    seen: np.ndarray  # bucket numbers, ascending
    parts: np.ndarray  # (seen + 1) x columns; the last row is zero
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: dict[str, float]

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The filters' parts of each word, computed once for each distinct word."""
        _, first, inverse = np.unique(bw.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        order = np.argsort(first)  # spans are hashed in the order of the buffer
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        buckets = word_buckets(buf, starts[first[order]], ends[first[order]])
        at = np.minimum(np.searchsorted(self.seen, buckets), len(self.seen) - 1) if len(self.seen) else np.zeros(buckets.shape, int)
        known = self.seen[at] == buckets if len(self.seen) else np.zeros(buckets.shape, bool)
        z = self.parts[np.where(known, at, len(self.seen))].sum(1) * evened(buckets)
        return z[place[inverse]]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The maximum of each filter over each of some texts; 0 for a text without words."""
        buf = bw.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        starts, ends = bw.spans(buf, bw.NOT_WORD)
        best = np.zeros((len(texts), len(self.bias)))
        if not len(starts):
            return best
        bounds = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(bounds, starts, side="right")
        z = np.zeros((len(starts) + BORDER * len(texts), self.parts.shape[1]), np.float32)
        z[np.arange(len(starts)) + BORDER * owner] = self.rows(buf, starts, ends)
        has, first = np.unique(owner, return_index=True)
        windows = convolved(np.concatenate([z, np.zeros((BORDER, z.shape[1]), z.dtype)]))
        # a text's windows begin at its words; those that begin at the zeros behind it belong to none
        begin = first + BORDER * has
        end = np.append(first[1:], len(starts)) + BORDER * has
        cuts = np.stack([begin, end], 1).ravel()
        for k, conv in enumerate(windows):
            best[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(conv, cuts)[::2]
        return best

    def pooled_long(self, text: bytes) -> np.ndarray:
        """The same for one text of any length, in pieces. A piece begins with the last BORDER words before it, and only
        the last piece has windows that run beyond its end."""
        whole, at = np.frombuffer(text, np.uint8), 0
        best, border, words = np.full(len(self.bias), -np.inf), np.zeros((0, self.parts.shape[1]), np.float32), 0
        while at < len(whole):
            end = min(len(whole), at + PIECE)
            while end < len(whole):
                cut = np.flatnonzero(bw.NOT_WORD[whole[at:end]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                    break
                end = min(len(whole), end + PIECE)
            buf = bw.LOWER[whole[at:end]]
            starts, ends = bw.spans(buf, bw.NOT_WORD)
            at = end
            if not len(starts):
                continue
            words += len(starts)
            z = np.concatenate([border, self.rows(buf, starts, ends)])
            if len(z) > BORDER:
                best = np.maximum(best, np.concatenate([c.max(0) for c in convolved(z)]))
            border = z[-BORDER:]
        if not words:
            return np.zeros(len(self.bias))
        tail = np.concatenate([border, np.zeros((BORDER, border.shape[1]), border.dtype)])
        return np.maximum(best, np.concatenate([c[: len(border)].max(0) for c in convolved(tail)]))

    def scores(self, texts: list[bytes]) -> list[float]:
        """Scores of texts, PIECE bytes of them at a time."""
        best = np.zeros((len(texts), len(self.bias)))
        group: list[int] = []
        room = PIECE

        def flush() -> None:
            if group:
                best[group] = self.pooled([texts[k] for k in group])
            group.clear()

        for k, t in enumerate(texts):
            if len(t) > PIECE:
                best[k] = self.pooled_long(t)
                continue
            if len(t) > room:
                flush()
                room = PIECE
            group.append(k)
            room -= len(t)
        flush()
        # an elementwise sum: a matrix product may add in another order for another number of rows
        logits = (np.maximum(best + self.bias, 0) * self.out).sum(1) + self.offset
        return [sigmoid(x) for x in logits.tolist()]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def constant(score: float) -> Scorer:
    """Every text alike."""
    count = FILTERS * len(WIDTHS)
    return Scorer(np.zeros(0, np.int32), np.zeros((1, FILTERS * len(COLUMNS)), np.float32), np.zeros(count), np.zeros(count), score, {})


def train(texts: list[bytes], labels: list[int], languages: list[str | None], clean_weight: float = 1.0, seed: int = 7, ratios: bool = True) -> Scorer:
    """Fit on labelled texts; clean_weight is how many clean documents each sampled one stands for.

    Without labels of both kinds the model scores every text alike, at the share of toxic labels (0 without labels).
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(30.0 if len(y) and y.min() == 1 else -30.0)
    # the sample comes in the order of a hash, so each one in CALIBRATE of a label is a fair share of it
    turn = np.zeros(len(y), int)
    for v in (0, 1):
        turn[y == v] = np.arange(int((y == v).sum()))
    kept = turn % CALIBRATE == CALIBRATE - 1
    if min((y[kept] == v).sum() for v in (0, 1)) < LEAST_OF_LABEL:
        kept = np.ones(len(y), bool)  # too few to share out: all fit, all calibrate
    fits = ~kept if not kept.all() else kept
    scorer = descend([t for t, f in zip(texts, fits.tolist(), strict=True) if f], y[fits], clean_weight, seed, ratios)
    return calibrated(scorer, [t for t, k in zip(texts, kept.tolist(), strict=True) if k], y[kept], [x for x, k in zip(languages, kept.tolist(), strict=True) if k], clean_weight)


def calibrated(scorer: Scorer, texts: list[bytes], y: np.ndarray, languages: list[str | None], clean_weight: float) -> Scorer:
    """Move the offset to the best cut of these texts, and give languages with enough of them their own thresholds."""
    weights = np.where(y > 0, 1.0, clean_weight)
    z = np.array([math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(40, p - 0.5) for p in scorer.scores(texts)])
    cut = best_cut(z, y, weights)
    scorer.offset -= cut
    scores = np.array([sigmoid(v) for v in z - cut])
    for language in sorted({x for x in languages if x is not None}):
        mine = np.array([x == language for x in languages])
        if min((y[mine] == v).sum() for v in (0, 1)) >= LEAST_OF_LANGUAGE:
            scorer.thresholds[language] = float(np.clip(best_cut(scores[mine], y[mine], weights[mine]), LOWEST, HIGHEST))
    return scorer


def descend(texts: list[bytes], y: np.ndarray, clean_weight: float, seed: int, ratios: bool) -> Scorer:
    """Gradient descent over the sample. Only buckets that it holds have embeddings: rows are numbered among those."""
    rng = np.random.default_rng(seed)
    count = FILTERS * len(WIDTHS)
    words, held = vocabulary(texts)
    seen = np.unique(words)
    seen = seen[seen != BUCKETS].astype(np.int32)
    none = len(seen)
    scale = evened(words)
    words = np.where(words == BUCKETS, none, np.minimum(np.searchsorted(seen, words), max(none - 1, 0))).astype(np.int32)
    embedding = rng.normal(0, 0.05, (none + 1, DIM)).astype(np.float32)
    filters = rng.normal(0, 0.2, (DIM, FILTERS * len(COLUMNS))).astype(np.float32)
    bias, out, offset = np.zeros(count), rng.normal(0, 0.1, count), -3.0
    if ratios:
        times = np.full((2, none + 1), 2.0)
        for x, label in zip(held, y.astype(int).tolist(), strict=True):
            if len(x):
                times[label, np.unique(words[np.unique(x)])] += 1 if label else clean_weight
        embedding[:, 0] = (np.log(times[1]) - np.log(times[0])) / SLOTS
        filters[0, 0], out[0] = 1.5, 1.0
    embedding[none] = 0
    weight = np.where(y > 0, 1.0, min(clean_weight, 4.0))
    past = np.full(none + 1, 1e-2)  # squared gradients of each bucket, and of the other parameters
    past_filters, past_bias, past_out, past_offset = (np.full_like(x, 1.0) for x in (filters, bias, out, np.zeros(1)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            batch = [k for k in order[start : start + BATCH].tolist() if len(held[k])]
            if not batch:
                continue
            lengths = np.array([len(held[k]) for k in batch])
            first = np.cumsum(lengths) - lengths
            own_words, place = np.unique(np.concatenate([held[k] for k in batch]), return_inverse=True)
            rows = words[own_words]
            summed = embedding[rows].sum(1) * scale[own_words]  # of each distinct word
            z = np.zeros((len(place) + BORDER * len(batch) + BORDER, filters.shape[1]), np.float32)
            z[np.arange(len(place)) + BORDER * np.repeat(np.arange(len(batch)), lengths)] = (summed @ filters)[place]
            windows = convolved(z)
            d_filters, d_bias, d_out, d_offset, at, by = np.zeros_like(filters), np.zeros(count), np.zeros(count), 0.0, [], []
            for b, k in enumerate(batch):
                begin = int(first[b]) + BORDER * b
                own = [w[begin : begin + lengths[b]] for w in windows]
                where = np.concatenate([x.argmax(0) for x in own])
                best = np.concatenate([x.max(0) for x in own])
                active = np.maximum(best + bias, 0)
                slope = weight[k] * (sigmoid(float(active @ out) + offset) - y[k])
                if abs(slope) < 1e-3:
                    continue
                d_out += slope * active
                d_offset += slope
                back = slope * out * (active > 0)
                d_bias += back
                for w, j, c in COLUMNS:
                    of = WIDTHS.index(w) * FILTERS
                    for f in np.flatnonzero(back[of : of + FILTERS]).tolist():
                        row = int(where[of + f]) + j
                        if row < lengths[b]:
                            word = int(place[first[b] + row])
                            d_filters[:, c + f] += back[of + f] * summed[word]
                            at.append(rows[word])
                            by.append(back[of + f] * scale[own_words[word]] * filters[:, c + f])
            if not at and not d_offset:
                continue
            if at:
                touched, inverse = np.unique(np.concatenate(at), return_inverse=True)
                moved = np.zeros((len(touched), DIM))
                np.add.at(moved, inverse, np.repeat(np.array(by), SLOTS, axis=0))
                past[touched] += (moved**2).sum(1)
                embedding[touched] -= (RATE * moved / np.sqrt(past[touched])[:, None]).astype(np.float32)
                embedding[none] = 0
            for value, slope, total in ((filters, d_filters, past_filters), (bias, d_bias, past_bias), (out, d_out, past_out)):
                total += slope**2
                value -= RATE * slope / np.sqrt(total)
            past_offset += d_offset**2
            offset -= float(RATE * d_offset / np.sqrt(past_offset[0]))
    return Scorer(seen, (embedding @ filters).astype(np.float32), bias, out, offset, {})


def best_cut(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the best F1 (halfway between the values beside it; of equal ones the highest)."""
    order = np.argsort(-z, kind="stable")
    z, hit, miss = z[order], np.cumsum((weights * y)[order]), np.cumsum((weights * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (weights * y).sum())
    f1[:-1][z[1:] == z[:-1]] = -1
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1e-6)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> tuple[list[tuple[bytes, int, str | None]], float]:
    """A bounded sample of labelled, not held-out documents, and how many clean ones each clean one stands for.

    Of each label, the first documents by a hash of their id, as many as `most` and as fit into `most_bytes` (a document that
    doesn't fit is passed over). Of rows that repeat a doc_id the one with the smallest text counts. So the driver gets at
    most 2 * most sizes, and then at most 2 * most texts of at most 2 * most_bytes together.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == v).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most) for v in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # 2 * most rows at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    found = own.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.octet_length("text")).alias("size")).collect()
    found.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).digest(), r.doc_id))
    chosen, room = {}, {0: most_bytes, 1: most_bytes}
    for r in found:
        if r["size"] <= room[r.toxic]:
            room[r.toxic] -= r["size"]
            chosen[r.doc_id] = (len(chosen), r.toxic, r["size"])
    if not chosen:
        return [], 1.0
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i, n) for i, (_, _, n) in chosen.items()], "doc_id bigint, size int"))
    rows = own.join(ids, "doc_id").where(F.octet_length("text") == F.col("size")).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).collect()
    rows.sort(key=lambda r: chosen[r.doc_id][0])
    used = sum(1 for _, v, _ in chosen.values() if v == 0)
    return [(r.r.text.encode(), chosen[r.doc_id][1], r.r.lang) for r in rows], max(1.0, sizes.get(0, 0) / max(1, used))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Scorer:
    rows, clean_weight = training_rows(docs, labels, most)
    return train([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], clean_weight)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The table without the documents whose score reaches the threshold of their language (0.5 for languages without one).

    Other rows stay as they are, repeated ones and columns of any name too. Null and empty texts are texts without words.
    Equal texts of one language stay or go together. Texts of any length are scored whole. An empty table gives an
    empty result, and without labels of both kinds nothing but what `train` says goes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        thresholds = sent.value.thresholds
        clean = [p < thresholds.get(lang, 0.5) for p, lang in zip(sent.value.scores(raw_texts(batch)), batch.column("lang").to_pylist(), strict=True)]
        return batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, lang, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # grows with the training sample, which is bounded, not with the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang")], pa.array(sent.value.scores(raw_texts(batch)), pa.float64())], ["doc_id", "lang", "score"])

    return map_arrow(narrow(docs, "doc_id", "text", "lang"), run, "doc_id bigint, lang string, score double")


def threshold_of(model: Scorer) -> Column:
    """The calibrated threshold of the row's language; 0.5 for other languages."""
    out = F.lit(0.5)
    for language, value in sorted(model.thresholds.items()):
        out = F.when(F.col("lang") == language, F.lit(value)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, score, predicted (score >= 0.5), threshold (of its language), flagged (score >= threshold).

    One row out for each row in. Null and empty texts are scored as texts without words. Labels other than 0 and 1 and
    labels of absent documents are ignored; of several labels of a document the toxic one counts. A null doc_id isn't held out.
    """
    model = fit(docs, labels)
    out = scored(docs, model).withColumn("threshold", threshold_of(model))
    return out.select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"),
    )
