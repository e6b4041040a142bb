"""Byte-level BPE by speculation: longest-match proposals, a vectorised check of adjacent tokens, merging only where it fails.

Why the check is enough. Merges have ranks; a merge's parts are made by merges of lower rank, so merging runs through
the ranks in order. Just before rank r, the boundary between two proposed tokens is touched on the left by one token of
the left token's right spine and on the right by one of the right token's left spine. The proposal is what merging
yields if and only if no merge of such a pair has the rank at which both are there. `compatible` walks both spines back
through the ranks for all pairs of a batch at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, texts

#: Entries that a worker's caches of encoded pieces hold before they start anew.
CACHE = 600_000
#: Beyond these ranges regular-expression libraries differ about letters; such texts are split by the tokenizers library.
EXOTIC = regex.compile(r"[^\x00-ɏͰ-ͷΑ-ΡΣ-ϿЀ-ԯḀ-ỿ -⁤₠-₿぀-ゖ゠-ヿ一-龥가-힣]")
#: Texts of these letters need no Unicode classes: the standard library's faster engine splits them alike.
LATIN = re.compile(r"[\x00-\x1b\x20-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ɏ‐-‧]*").fullmatch
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
NONE = np.iinfo(np.int64).max
#: Longer words are proposed from all their bytes at once and mended where the check fails, not merged as a whole.
LONG = 256


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary read from a file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model, added = spec["model"], spec["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([self.id_of[as_bytes(x)] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        size = max(self.bytes_of) + 1
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a byte
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        self.merge = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.made = made.tolist()
        keys = left << 32 | right
        self.rank_of = {k: r for r, k in enumerate(keys.tolist())}
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order
        sound = self._unbroken(left, right, np.arange(len(made)))
        valid = dict.fromkeys(range(256), True)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), sound.tolist(), strict=True):
            valid[m] = ok and valid.get(a, True) and valid.get(b, True)
        #: Tokens that merging makes of their own bytes; only these are proposed.
        self.proposed = {b: i for b, i in self.id_of.items() if valid.get(i, True)}
        self._grow()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[str, str] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    @cached_property
    def pattern(self):
        from public_tokenizers import PATTERN

        return regex.compile(PATTERN)

    def _unbroken(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does no merge across their boundary happen before rank `until`?"""
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        ends_a, ends_b = until.copy(), until.copy()
        while len(live):
            at = np.minimum(np.searchsorted(self.keys, a << 32 | b), len(self.keys) - 1)
            r = np.where(self.keys[at] == (a << 32 | b), self.key_ranks[at], NONE)
            made_a, made_b = self.rank[a], self.rank[b]
            # of equal ranks the left merge comes first
            broken = (r != NONE) & (r > made_a) & (r > made_b) & (r < ends_a) & ((r < ends_b) | ((r == ends_b) & (r < until[live])))
            ok[live[broken]] = False
            back_a = made_a > made_b
            on = ~broken & ((made_a >= 0) | (made_b >= 0))
            ends_a, ends_b = np.where(back_a, made_a, ends_a), np.where(back_a, ends_b, made_b)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            live, a, b, ends_a, ends_b = live[on], a[on], b[on], ends_a[on], ends_b[on]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._unbroken(a, b, np.full(len(a), NONE, np.int64))

    def _grow(self) -> None:
        """The proposable tokens as a trie: sorted keys (node << 8 | byte), the node that each leads to, its token or -1."""
        step: dict[int, int] = {}
        token = [-1]
        for word, i in self.proposed.items():
            node = 0
            for b in word:
                node = step.setdefault(node << 8 | b, len(step) + 1)
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.steps = np.array(sorted(step), np.int64)
        self.leads = np.array([step[k] for k in self.steps.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.from_root = np.array([step[b] for b in range(256)], np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each position, for all words at once: token ids in order, and where each word's end."""
        lengths = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        ends = np.cumsum(lengths)
        long = np.flatnonzero(lengths > LONG).tolist()
        found = np.full(len(buf), -1, np.int64)  # the token that begins at each byte
        live = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        start, at, stop = (ends - lengths)[live], (ends - lengths)[live], ends[live]
        node = np.zeros(len(live), np.int64)
        best, after = np.full(len(live), -1, np.int64), start.copy()
        while len(start):
            root = node == 0
            key = node << 8 | buf[at]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            goes = (self.steps[k] == key) & (at < stop)
            node = np.where(goes, self.leads[k], 0)
            node[root] = self.from_root[buf[at[root]]]
            goes |= root
            at = np.where(goes, at + 1, at)
            token = self.token[node]
            better = goes & (token >= 0)
            best, after = np.where(better, token, best), np.where(better, at, after)
            cut = ~goes
            found[start[cut]] = best[cut]
            start, at = np.where(cut, after, start), np.where(cut, after, at)
            on = ~cut | (start < stop)
            if not on.all():
                start, at, stop, node, best, after = start[on], at[on], stop[on], node[on], best[on], after[on]
        for k in long:
            begin, end = int(ends[k] - lengths[k]), int(ends[k])
            tokens, sizes = self.longest(buf[begin:end])
            places = self.chain(sizes)
            found[begin + places] = tokens[places]
        places = np.flatnonzero(found >= 0)
        return found[places], np.searchsorted(places, ends)

    def longest(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each byte of a word, and its length; all bytes take their steps together."""
        live = np.arange(len(word))
        node = self.from_root[word]
        tokens, sizes = self.token[node], np.ones(len(word), np.int64)
        depth = 1
        while True:
            on = live + depth < len(word)
            live, node = live[on], node[on]
            if not len(live):
                return tokens, sizes
            key = node << 8 | word[live + depth]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            goes = self.steps[k] == key
            live, node = live[goes], self.leads[k[goes]]
            depth += 1
            token = self.token[node]
            ends = token >= 0
            tokens[live[ends]], sizes[live[ends]] = token[ends], depth

    @staticmethod
    def chain(sizes: np.ndarray) -> np.ndarray:
        """Where tokens begin, if each is followed by the one at its end."""
        out, at, steps = [], 0, sizes.tolist()
        while at < len(steps):
            out.append(at)
            at += steps[at]
        return np.array(out, np.int64)

    def mended(self, word: bytes, ids: list[int], failing: list[int]) -> list[int]:
        """The tokens of a long word whose proposal fails at some boundaries (numbers of the tokens before them).

        Only the bytes around a failing boundary are merged anew, in stretches of bounded length. Then the boundaries of
        these stretches are checked, and those that fail are mended in the next round with longer stretches, the
        whole word at last. Once all adjacent pairs are compatible, the whole is what merging yields.
        """
        reach, most = 2, 64
        while failing:
            starts = np.concatenate(([0], np.cumsum([len(self.bytes_of[i]) for i in ids]))).tolist()
            out: list[int] = []
            borders: list[int] = []  # numbers of the new tokens before the boundaries to check
            known: dict[bytes, list[int]] = {}
            at, n = 0, 0
            while n < len(failing):
                a = max(at, failing[n] + 1 - reach)
                b = failing[n] + 1 + reach
                while n < len(failing) and failing[n] + 1 < b:  # what this stretch covers
                    b = min(max(b, failing[n] + 1 + reach), a + most)
                    n += 1
                b = min(b, len(ids))
                out += ids[at:a]
                borders.append(len(out) - 1)
                piece = word[starts[a] : starts[b]]
                if piece not in known:
                    known[piece] = self.merged(piece)
                out += known[piece]
                borders.append(len(out) - 1)
                at = b
            out += ids[at:]
            ids = out
            check = np.unique([k for k in borders if 0 <= k < len(ids) - 1]).astype(np.int64)
            if len(check):
                flat = np.array(ids, np.int64)
                check = check[~self.compatible(flat[check], flat[check + 1])]
            failing = check.tolist()
            reach, most = 2 * reach, 4 * most
        return ids

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, of equal ones the leftmost."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        if len(ids) > 64:
            return self._merged_long(ids)
        get, none = self.rank_of.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            ids[k : k + 2] = [self.made[r]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of adjacent pairs, in n log n steps."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*m, k) for k in range(len(ids) - 1) if (m := self.merge.get((ids[k], ids[k + 1])))]
        heap = [(r, k, m) for r, m, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made = heapq.heappop(heap)
            if ids[k] < 0 or (j := after[k]) >= len(ids) or (m := self.merge.get((ids[k], ids[j]))) is None or m[1] != made:
                continue
            ids[k], ids[j], after[k] = made, -1, after[j]
            if after[k] < len(ids):
                before[after[k]] = k
                if m := self.merge.get((made, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, m[1]))
            if before[k] >= 0 and (m := self.merge.get((ids[before[k]], made))):
                heapq.heappush(heap, (m[0], before[k], m[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, as merging yields them."""
        if not words:
            return []
        flat, ends = self.propose(words)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = False
        at = np.flatnonzero(inner)
        failing = at[~self.compatible(flat[at], flat[at + 1])] if len(at) else at
        ids, bounds = flat.tolist(), [0, *ends.tolist()]
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        owner = np.searchsorted(ends, failing, side="right")
        for k in np.unique(owner).tolist():
            out[k] = self.merged(words[k]) if len(words[k]) <= LONG else self.mended(words[k], out[k], (failing[owner == k] - bounds[k]).tolist())
        return out

    def split(self, text: str) -> list[str]:
        """Pieces within which merges happen."""
        if LATIN(text):
            return LATIN_PIECES(text)
        if EXOTIC.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache doesn't have."""
        new = list(pieces - self.pieces.keys())
        if len(self.pieces) + len(new) > CACHE:
            self.pieces, new = {}, list(pieces)
        for piece, ids in zip(new, self.encode_words([p.encode() for p in new]), strict=True):
            self.pieces[piece] = ",".join(map(str, ids))

    def encode_batch(self, batch: list[str]) -> list[str]:
        """The ids of each text, comma-joined."""
        out = []
        for k in range(0, len(batch), 500):
            parts = [self.split_special.split(t) if self.split_special else [t] for t in batch[k : k + 500]]
            cut = [[[x] if j % 2 else self.split(x) for j, x in enumerate(p)] for p in parts]
            self.learn(set().union(*[x for c in cut for x in c[::2]]))
            get = self.pieces.__getitem__
            for c in cut:
                ids = [str(self.special[x[0]]) if j % 2 else ",".join(map(get, x)) for j, x in enumerate(c)]
                out.append(",".join(filter(None, ids)))
        return out

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids, special tokens included."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, map(int, ids.split(",")))).decode("utf-8", "replace") if ids else ""


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def bpe_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; null and empty texts have no ids."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [[int(i) for i in x.split(",")] if x else [] for x in load(path).encode_batch(texts(batch))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, ids array<int>")


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256 (of comma-joined ids), decoded_sha256 (of the text decoded from them).

    One row out for each row in, in any order; rows that repeat a doc_id or a text are encoded each. A null text is an
    empty one (no tokens), a null doc_id stays null, and an empty table gives an empty result. Texts of any length are
    encoded whole, words of any length in time near linear in them. Of merges of one rank the leftmost comes first. Other
    columns, whatever their names, are ignored.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = bpe.encode_batch(texts(batch))
        counts = [x.count(",") + 1 if x else 0 for x in ids]
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
