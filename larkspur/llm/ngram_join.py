"""Jaccard self-join on word n-grams by T-occurrence search (DivideSkip), and the classes that its links form.

How a pair of similar texts is brought together, at any size:

1. Texts with the same words are one class, which its smallest doc_id represents.
2. A text of n shingles keeps its n - ceil(t n) + 1 rarest ones; two texts of similarity t or more share one of
   those. Rarity is read from a sketch of fixed size (counts of hash buckets over all texts). Any fixed order is
   correct; rarest first keeps passages that very many texts share out of the lists.
3. Each list of texts that keep a shingle gives pairs of a text and a pivot (list_pairs), after length and positional
   filters. A text joins the group of each of its pivots. So a linked pair meets in a group of the first shingle that
   it shares, and a thousand near copies meet in a few groups rather than in one for each shingle.
   Joins of members with all documents are merge joins at every size: the members grow with the documents, so a
   broadcast that happens to fit a small table would say nothing about a large one.
4. A group is searched in blocks of bounded size, each with the pivot. Members whose bitmaps rule out every other one
   leave first, and the texts of the rest are fetched. Then every member is a query against the block's
   inverted lists. The longest lists are left aside, the short ones are merged, and whoever reaches
   T - (lists left aside) is probed by binary search in these. Members that are already connected are not compared.
   (Merging is one stable sort of the lists put end to end, at every size; a heap in Python takes the same steps at
   a hundred times the cost. With it, a merged entry is far cheaper than a probe, which MU says.)
5. Groups of several blocks get a second round for pairs that fell into different blocks and aren't connected. One of
   the two isn't connected with the pivot; it asks. Those that ask and the others are cut into blocks, and pairs of
   blocks are searched, both sides of bounded size. A member goes into as many pairs as there are blocks that ask. Where
   these are more than WIDE, the group is first divided by agreement: the tokens are dealt into one part
   more than two similar sets can differ in (agreement_keys), so similar sets agree on a whole part, of about six tokens,
   and only members that do are brought together. Both ways find every link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, shingles, word_hashes
from .common import checkpoint, map_arrow, map_batches, narrow, raw_texts, scratch
from .components import connected_components

#: Counters of the frequency sketch.
SKETCH = 1 << 16
#: Members of a group that one search holds at a time (of a pair of blocks: on each side).
BLOCK = 512
#: Blocks of asking members from which a group is divided by agreement.
WIDE = 64
#: Texts of a list up to which its pairs are looked at one by one.
FEW = 8
#: The cost factor by which DivideSkip chooses how many lists to leave aside.
MU = 0.5


def ceil_share(n, percent: int):
    """ceil(percent / 100 * n) in integers."""
    return -(-percent * n // 100)


def ceil_div(a, b: int):
    return -(-a // b)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text whose A-Z are lower-cased."""
    return np.unique(shingles(word_hashes(text, lower=True), size))


def bitmap(own: np.ndarray) -> bytes:
    """About half a bit for each token: the parity of the tokens that fall on it. A power of two of bits, 64 or more."""
    size = max(64, 1 << (len(own) // 2).bit_length())
    places = ((own >> np.uint64(16)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(rows: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of half as many bits."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def in_reach(bits: list[bytes], sizes: np.ndarray, labels: np.ndarray, asks: np.ndarray, percent: int) -> np.ndarray:
    """Which members may link with another one of another label, one of the two being a query.

    The bitmap filter: where b bits of two bitmaps differ, b tokens at least are in one set only.
    """
    alive = np.zeros(len(bits), bool)
    widths = np.array([len(b) // 8 for b in bits])
    for width in np.unique(widths):
        mine, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        rows = np.frombuffer(b"".join([bits[k] for k in mine]), np.uint64).reshape(len(mine), width)
        if len(wider):
            rows = np.concatenate([rows, folded(np.frombuffer(b"".join([bits[k] for k in wider]), np.uint64).reshape(len(wider), 2 * width))])
        who = np.concatenate([mine, wider])
        order = np.argsort(sizes[who], kind="stable")
        rows, who = rows[order], who[order]
        n = sizes[who]
        ends = np.searchsorted(n, 100 * n // percent, side="right")
        for k, x in enumerate(who.tolist()):
            near = slice(k + 1, int(ends[k]))
            others = who[near]
            if not len(others):
                continue
            most = (n[k] + n[near] - np.bitwise_count(rows[near] ^ rows[k]).sum(1, dtype=np.int64)) // 2
            ok = (100 * most >= percent * (n[k] + n[near] - most)) & (labels[others] != labels[x]) & (asks[others] | asks[x])
            if ok.any():
                alive[x] = True
                alive[others[ok]] = True
    return alive


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """In how many texts the shingles of each hash bucket stand: SKETCH counters, whatever the size of the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in raw_texts(batch):
                total += np.bincount((shingle_set(text, size) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(SKETCH, np.int64)
    for row in map_batches(docs.select("text"), count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), digest (of the word sequence; null without words), bits (bitmap), prefix (its rarest shingles)."""
    rarity = frequency_sketch(docs, size)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        ns, digests, bits, kept, sizes = [], [], [], [], [0]
        for text in raw_texts(batch):
            words = word_hashes(text, lower=True)
            own = np.unique(shingles(words, size))
            ns.append(len(own))
            digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
            bits.append(bitmap(own))
            k = len(own) - ceil_share(len(own), percent) + 1 if len(own) else 0
            order = np.argsort(rarity[(own & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:k]
            kept.append(own[order])
            sizes.append(sizes[-1] + k)
        flat = np.concatenate(kept).view(np.int64)
        arrays = [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "bits", "prefix"])

    return map_arrow(docs.select("doc_id", "text"), sign, "doc_id bigint, n bigint, digest binary, bits binary, prefix array<bigint>")


class Links:
    """Union-find over the members of a block, and the links that joined them."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]
        self.left = len(first)
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        self.left -= 1
        self.made.append((x, y))


def divide_skip(sets: list[np.ndarray], percent: int, labels: list[int] | None = None, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (pairs of positions) that connect all members whose sets have a Jaccard similarity of percent or more.

    Members with the same label count as connected already. With queries given, only pairs with one of them are sought.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    links = Links(list(range(len(sets))) if labels is None else labels)
    if links.left < 2 or not sizes.sum():
        return []
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owners = np.repeat(np.arange(len(sets), dtype=np.int16 if len(sets) < 1 << 15 else np.int64), sizes)[order]
    names, begins = np.unique(tokens[order], return_index=True)
    lengths = np.diff(np.append(begins, len(tokens)))
    for x in range(len(sets)) if queries is None else queries:
        if links.left < 2:
            break
        n = int(sizes[x])
        if not n:
            continue
        need = int(ceil_share(n, percent))
        at = np.searchsorted(names, sets[x])
        at = at[lengths[at] > 1]
        if len(at) < need:
            continue
        at = at[np.argsort(lengths[at], kind="stable")]
        aside = min(need - 1, int(need / (MU * np.log2(lengths[at[-1]]) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.sort(np.concatenate([owners[begins[k] : begins[k] + lengths[k]] for k in short.tolist()]), kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        counts = np.diff(np.append(starts, len(merged)))
        enough = counts >= need - aside
        near, shared = merged[starts[enough]].astype(np.int64), counts[enough]
        fits = (100 * np.minimum(sizes[near], n) >= percent * np.maximum(sizes[near], n)) & (near != x)
        probes = np.sort(names[long])
        for y, c in zip(near[fits].tolist(), shared[fits].tolist(), strict=True):
            if links.root(x) == links.root(y):
                continue
            m, own = int(sizes[y]), sets[y]
            where = np.minimum(np.searchsorted(own, probes), m - 1)
            both = c + int((own[where] == probes).sum())
            if 100 * both >= percent * (n + m - both):
                links.join(x, y)
    return links.made


MEMBER = "held bigint, doc_id bigint, label bigint, query boolean"
MEMBERS = ["held", "doc_id", "label", "query"]


def by_block(rows: DataFrame, columns: list[str], found: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Run found() on the rows of each value of held, which are at most about two BLOCKs, and give the rows that it returns."""
    held = rows.repartition("held").sortWithinPartitions("held", "doc_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def out(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.bool_() if x.endswith("boolean") else pa.int32() if x.endswith("int") and not x.endswith("bigint") else pa.int64() for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            made: list[tuple] = []
            cols = [batch.column(c).cast(pa.binary()).to_pylist() if c == "text" else batch.column(c).to_pylist() for c in columns]
            for row in zip(*cols, strict=True):
                if row[0] != key:
                    if len(group) > 1:
                        made += found(group)
                    key, group = row[0], []
                group.append(row)
            yield out(made)
        if len(group) > 1:
            yield out(found(group))

    return map_batches(held.select(*columns), run, schema)


def in_reach_members(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Those of members (held, doc_id, label, query) that the bitmap filter lets through, among those of each value of held."""

    def alive(group: list[tuple]) -> list[tuple]:
        _, _, labels, asks, n, bits = zip(*group, strict=True)
        keep = in_reach(list(bits), np.array(n), np.array(labels), np.array(asks), percent)
        return [row[:4] for row, k in zip(group, keep.tolist(), strict=True) if k]

    return by_block(members.join(own.select("doc_id", "n", "bits").hint("merge"), "doc_id"), [*MEMBERS, "n", "bits"], alive, MEMBER)


def block_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """members (held, doc_id, label, query, text) -> links (a, b) found among those of each value of held."""

    def found(group: list[tuple]) -> list[tuple]:
        _, ids, labels, asks, texts = zip(*group, strict=True)
        sets = [shingle_set(t or b"", size) for t in texts]
        asking = [k for k, q in enumerate(asks) if q]
        pairs = divide_skip(sets, percent, list(labels), None if len(asking) == len(ids) else asking)
        return [(ids[a], ids[b]) for a, b in pairs]

    return by_block(members, [*MEMBERS, "text"], found, "a bigint, b bigint")


def list_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """tokens (token, doc_id, n, at: the token's place in the text's order) -> (doc_id, pivot), distinct.

    Of the tokens that a linked pair shares, one comes first in the order; after it, both texts must still hold enough
    tokens to reach the required overlap (the positional filter). A list of few texts gives the pairs that pass. A longer
    one is cut into bands of similar n, in which the first text is the pivot of all others; bands overlap, so that
    a linked pair has one in common. A list is read as a stream and never held.
    """
    held = tokens.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    width = -np.log(percent / 100) * 1.001

    def reach(n, at, m):
        """Can a text of n tokens, with `at` tokens before the shared one, overlap enough with one of m tokens?"""
        return 100 * (n - at) >= ceil_div(100 * percent * (n + m), 100 + percent)

    def few(token, doc, n, at, runs, short):
        """Pairs in lists of at most FEW texts; short marks their rows."""
        out = []
        for k in range(1, FEW):
            x = np.flatnonzero(short[:-k] & (runs[k:] == runs[:-k])) if len(runs) > k else np.zeros(0, int)
            y = x + k
            x_y = reach(n[x], at[x], n[y]) & reach(n[y], at[y], n[x]) & (100 * n[x] >= percent * n[y]) & (doc[x] != doc[y])
            out.append((doc[y[x_y]], doc[x[x_y]]))
        return out

    def many(doc, n, at, firsts):
        """Each text of a long list with the pivots of its bands; firsts: those known so far."""
        bands = (np.log(n) / width).astype(int)
        out = []
        for b in np.unique(bands).tolist():
            mine = bands == b
            firsts.setdefault(b, int(doc[mine][0]))
            may = mine & reach(n, at, ceil_share(n, percent))
            for g in (b, b - 1):
                if g in firsts:
                    out.append((doc[may & (doc != firsts[g])], firsts[g]))
        return [(d, np.full(len(d), f)) for d, f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        long_token, firsts = None, {}

        def pairs(cols, last):
            nonlocal kept, long_token, firsts
            token, doc, n, at = cols
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            lengths = np.diff(np.append(starts, len(token)))
            out, hold = [], len(token)
            rest = int(lengths[0]) if token[0] == long_token else 0
            if rest:  # of the list that was long in an earlier batch; before another list takes its place
                out += many(doc[:rest], n[:rest], at[:rest], firsts)
            long = (lengths > FEW) & (starts >= rest)
            for s, size in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
                long_token, firsts = token[s], {}
                out += many(doc[s : s + size], n[s : s + size], at[s : s + size], firsts)
            if not last and lengths[-1] <= FEW and token[-1] != long_token:  # it may go on in the next batch
                hold = int(starts[-1])
            runs = np.repeat(np.arange(len(starts)), lengths)
            short = np.repeat((lengths > 1) & (lengths <= FEW), lengths)
            short[hold:] = False
            short[:rest] = False
            kept = [c[hold:] for c in cols]
            return out + few(token, doc, n, at, runs, short)

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(2)], ["doc_id", "pivot"])

        for batch in batches:
            cols = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("token", "doc_id", "n", "at"), strict=True)]
            if len(cols[0]):
                yield batch_of(pairs(cols, False))
        if len(kept[0]):
            yield batch_of(pairs(kept, True))

    return map_batches(held, run, "doc_id bigint, pivot bigint").distinct()


def agreement_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set, of which two sets of a Jaccard similarity of percent or more have one in common.

    Of sets of n and m tokens, at most (n + m)(100 - percent) / (100 + percent) tokens stand in one only. Tokens are dealt
    by a hash into one part more than that, so one part at least is the same in both. The number of parts must be the
    same too: it is that of the largest sets in two neighbouring bands of n, and a set is dealt for its own band and the next one
    with the one below it. A key is a hash of the bands, the part and its tokens.
    """
    n = len(own)
    width = -math.log(percent / 100) * 1.001
    band = int(math.log(n) / width) if n else 0
    out = []
    for low in range(max(0, band - 1), band + 1) if n else ():
        largest = int(math.exp((low + 2) * width)) + 1
        parts = 2 * largest * (100 - percent) // (100 + percent) + 1
        salted = mix(own + np.uint64(0x9E3779B97F4A7C15 * (low + 1) % 2**64))
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (salted % np.uint64(parts)).astype(np.int64), mix(salted))
        out.append(mix(sums + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(low)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def paired_blocks(crowded: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """crowded (pivot, doc_id, label, main) -> members (held, doc_id, label, query) of pairs of bounded blocks."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [agreement_keys(shingle_set(t, size), percent) for t in raw_texts(batch)]
        offsets = np.cumsum([0, *map(len, found)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))], ["doc_id", "keys"])

    crowded = crowded.select("pivot", "doc_id", "label", (F.col("label") != F.col("main")).alias("query"))
    wide = checkpoint(crowded.groupBy("pivot").agg(F.count_if("query").alias("a")).where(F.col("a") > WIDE * BLOCK).select("pivot"))
    rows = crowded.withColumn("key", F.lit(0).cast("bigint"))
    if not wide.isEmpty():
        divided = crowded.join(wide, "pivot", "left_semi")
        who = divided.select("doc_id").distinct()
        keyed = checkpoint(map_arrow(docs.join(who.hint("merge"), "doc_id", "left_semi").select("doc_id", "text"), keys, "doc_id bigint, keys array<bigint>"))
        keyed = divided.join(keyed, "doc_id").withColumn("key", F.explode("keys")).drop("keys").distinct()
        rows = checkpoint(rows.join(wide, "pivot", "left_anti").unionByName(keyed))
    groups = rows.groupBy("pivot", "key").agg(
        F.count_if("query").alias("a"), F.count_if(~F.col("query")).alias("t"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("same")
    ).where("a > 0 and lo <> hi")
    # near copies agree on many parts: of groups of the same members one is enough
    groups = groups.groupBy("pivot", "a", "t", "same").agg(F.min("key").alias("key")).drop("same")
    groups = groups.select("pivot", "key", (F.col("a") + F.col("t") <= BLOCK).alias("one"), F.ceil(F.col("a") / BLOCK).alias("na"), F.ceil(F.col("t") / BLOCK).alias("nt"))
    own = "pmod(xxhash64(doc_id, key), if(query, na, nt))"
    asked = f"concat(transform(sequence(0L, na - 1), x -> least(x, {own}) * na + greatest(x, {own})), if(nt > 0, transform(sequence(0L, nt - 1), y -> na * na + {own} * nt + y), array()))"
    other = f"transform(sequence(0L, na - 1), x -> na * na + x * nt + {own})"
    dealt = rows.join(groups, ["pivot", "key"]).select("pivot", "key", "doc_id", "label", "query", F.explode(F.expr(f"if(one, array(0L), if(query, {asked}, {other}))")).alias("block"))
    return checkpoint(dealt.select(F.xxhash64("pivot", "key", "block").alias("held"), "doc_id", "label", "query"))


def representative_links(docs: DataFrame, signed: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect the representatives of all similar classes."""
    own = signed.where("digest is not null").join(classes.select(F.col("first").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    tokens = own.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    joined = checkpoint(list_pairs(tokens.select("token", "doc_id", "n", "at"), percent))
    blocks = joined.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wide = blocks.where("blocks > 1")
    placed = joined.join(wide, "pivot", "left").select("pivot", F.expr("cast(pmod(xxhash64(doc_id), coalesce(blocks, 1)) as int)").alias("block"), "doc_id")
    pivots = blocks.select("pivot", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("pivot").alias("doc_id"))
    members = placed.unionByName(pivots).select(F.xxhash64("pivot", "block").alias("held"), "doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("query"))
    wide = checkpoint(wide)
    near = checkpoint(in_reach_members(members, own, percent))
    # all texts are shuffled once: for the members of this round, and (without held) for those that may be in the next
    later = joined.join(wide, "pivot").select("doc_id").union(wide.select("pivot")).distinct()
    fetched = checkpoint(near.unionByName(later, allowMissingColumns=True).join(docs.select("doc_id", "text").hint("merge"), "doc_id"))
    links = checkpoint(block_links(fetched.where("held is not null"), size, percent))
    if wide.isEmpty():
        return links
    labels = connected_components(links).withColumnRenamed("vertex", "doc_id").withColumnRenamed("component", "label")
    crowded = joined.join(wide, "pivot").select("pivot", "doc_id").union(wide.select("pivot", F.col("pivot").alias("doc_id")))
    crowded = crowded.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = crowded.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("pivot")
    main = labels.select(F.col("doc_id").alias("pivot"), F.col("label").alias("main"))
    crowded = checkpoint(crowded.join(mixed, "pivot").join(main, "pivot", "left").withColumn("main", F.coalesce("main", "pivot")))
    if crowded.isEmpty():
        return links
    texts = fetched.where("held is null").select("doc_id", "text")
    again = checkpoint(in_reach_members(paired_blocks(crowded, texts, size, percent), own, percent))
    return links.unionByName(checkpoint(block_links(again.join(texts.hint("merge"), "doc_id"), size, percent)))


def ngram_jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (smallest doc_id reachable by links of percent or more).

    One row out for each row in. Null and wordless texts have no shingles, link with nothing and are their own
    component. Fewer than `size` words: the whole sequence is the one shingle. Rows that repeat a doc_id count as
    one node. A row whose doc_id is null takes its class's component, or null if it has none. Texts of any length are
    compared whole. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    docs = narrow(docs, "doc_id", "text")
    with scratch(docs.sparkSession):
        signed = checkpoint(signatures(docs, size, percent))
        slim = checkpoint(signed.select("doc_id", "n", "digest"), out=True)
        classes = checkpoint(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first")))
        links = representative_links(docs, signed, classes, size, percent)
        found = connected_components(links).select(F.col("vertex").alias("first"), "component")
        named = checkpoint(classes.join(found, "first", "left").select("digest", F.coalesce("component", "first").alias("component")), out=True)
    return (
        slim.join(named.hint("merge"), "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The table with one row for each component of linked documents: that of its smallest doc_id.

    Null, empty and wordless texts are linked with nothing and stay. Of rows that repeat a doc_id one stays. Rows without a
    doc_id stay. Texts of any length are compared whole; columns of any name stay as they are; an empty table gives
    an empty result.
    """
    found = ngram_jaccard_join(docs, size, percent)
    copies = checkpoint(found.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct())
    out = docs.join(copies.hint("merge"), docs["doc_id"] == copies["copy_id"], "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("`count` > 1")
    if repeated.isEmpty():
        return out
    return out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id"]))
