"""Sharding by a minimax contiguous partition: shards of near-equal bytes, equal texts together, native throughout.

The atomic groups are the distinct texts, in the order of their digests. The smallest feasible capacity is found by
binary search, checking greedily; then shards are cut, each as near to its fair share as that capacity lets it.

The groups are never collected. The driver holds a trie over digest prefixes: bytes by prefix, 4,096 nodes at first.
A greedy step that ends inside a node is known only to lie between the node's begin and the step's reach; searching with
either bound gives a lower and an upper bound of the capacity. Nodes in which they differ are opened by one more
aggregate (256 children each, REFINED nodes at most at a time) until the bounds meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, narrow

#: Nodes that one aggregate opens at most; it returns at most 256 times as many rows.
REFINED = 64
FIRST, MORE = 3, 2  # hex digits of a first prefix, and of each further step


@dataclass(frozen=True)
class Node:
    prefix: str
    size: int
    low: str  # smallest and largest digest in it
    high: str

    @property
    def atomic(self) -> bool:
        return self.low == self.high


class Boundaries:
    """Where groups end, as far as the nodes show."""

    def __init__(self, nodes: list[Node]):
        self.nodes = sorted(nodes, key=lambda n: n.low)
        self.ends = [0, *accumulate(n.size for n in self.nodes)]
        self.total = self.ends[-1]

    def inside(self, x: int) -> Node | None:
        """The unopened node that x lies strictly inside of."""
        k = bisect_right(self.ends, x) - 1
        return None if self.ends[k] == x or k >= len(self.nodes) or self.nodes[k].atomic else self.nodes[k]

    def below(self, x: int, reach: bool = False) -> int:
        """The last end at or before x; reach: x itself if it lies in an unopened node."""
        x = min(x, self.total)
        return x if reach and self.inside(x) else self.ends[bisect_right(self.ends, x) - 1]

    def above(self, x: int) -> int:
        return self.ends[bisect_left(self.ends, max(x, 0))]

    def greedy(self, capacity: int, shards: int, reach: bool) -> list[int]:
        """The ends of greedily filled shards."""
        out, at = [], 0
        for _ in range(shards):
            at = self.below(at + capacity, reach)
            out.append(at)
        return out

    def capacity(self, shards: int, reach: bool) -> int:
        """The smallest capacity that greedy filling finds feasible."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, shards, reach)[-1] >= self.total else (mid + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[Node]]:
        """Ends of all shards but the last, and the unopened nodes that were asked about.

        A shard ends at its fair share of what is left, or where the rest still fits, whichever is later.
        """
        asked: list[int] = []
        least = [self.total]
        for _ in range(shards - 1):
            asked.append(least[-1] - capacity)
            least.append(self.above(least[-1] - capacity))
        least = least[:0:-1]
        out, at = [], 0
        for k, floor in enumerate(least):
            fair = at + min(capacity, -(-(self.total - at) // (shards - k)))
            asked.append(fair)
            end = max(floor, self.below(fair))
            if end == at < self.total:  # its next group is larger than its fair share
                asked.append(at + 1)
                end = self.above(at + 1)
            at = end
            out.append(at)
        nodes = [self.inside(x) for x in asked if 0 < x < self.total]
        return out, [n for n in nodes if n]


def opened(groups: DataFrame, nodes: list[Node] | None) -> list[Node]:
    """Nodes of the first level, or the children of nodes."""
    if nodes is None:
        child: Column = F.substring("digest", 1, FIRST)
    else:
        child = F.lit(None).cast("string")
        for depth in sorted({len(n.prefix) for n in nodes}):
            own = F.substring("digest", 1, depth).isin([n.prefix for n in nodes if len(n.prefix) == depth])
            child = F.when(own, F.substring("digest", 1, depth + MORE)).otherwise(child)
    rows = groups.withColumn("prefix", child).where("prefix is not null").groupBy("prefix").agg(F.sum("size").alias("size"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return [Node(r.prefix, r["size"], r.low, r.high) for r in rows.collect()]


def minimax_cuts(expand: Callable[[list[Node] | None], list[Node]], shards: int) -> list[str]:
    """The last digest of every shard but the last ('' before the first); expand gives children of nodes, or the first."""
    nodes = expand(None)
    while True:
        known = Boundaries(nodes)
        low, high = known.capacity(shards, True), known.capacity(shards, False)
        if low == high:
            cuts, todo = known.cuts(high, shards)
        else:
            spans = list(zip(known.greedy(low, shards, False), known.greedy(high, shards, True), strict=True))
            todo = [n for n, a, b in zip(known.nodes, known.ends, known.ends[1:], strict=False) if not n.atomic and any(a <= hi and b >= lo for lo, hi in spans)]
        if not todo:
            at = dict(zip(known.ends[1:], known.nodes, strict=True))
            return [at[c].high if c else "" for c in cuts]
        todo = sorted(set(todo), key=lambda n: (-n.size, n.prefix))[:REFINED]
        gone = set(todo)
        nodes = [n for n in nodes if n not in gone] + expand(todo)


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Columns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: this law doesn't grow by key).

    size is the UTF-8 length plus 1; a null text counts as an empty one, in size, checksum and group. One row out for
    each row in; rows with equal texts share a shard. Slots count from 0 in every shard without gaps, in the order of a
    hash of the doc_id and the text; rows without a doc_id are dealt by the partition that they were read in, so that very
    many of them don't meet in one task. Shards may be empty when groups are few or huge. Texts of any length count whole.
    An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = narrow(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = checkpoint(rows)
    cuts = minimax_cuts(lambda nodes: opened(rows, nodes), shards)
    shard = sum(((F.col("digest") > cut).cast("int") for cut in cuts), F.lit(0))
    placed = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(4096)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = F.broadcast(counts.select("shard", "bucket", before.alias("before")))  # 4,096 rows a shard at most
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    numbered = placed.withColumn("at", at).join(offsets, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
