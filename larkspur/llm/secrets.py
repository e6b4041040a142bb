"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further tokens.

Tokens are runs of the secret alphabet. The field labels each as begin of a secret, inside one, or outside (O), from its
shape, the words beside it and features of the file, and is decoded by Viterbi. A token is free to take any label if it
has the look of a secret (LONG characters or more, with a digit or mixed case), or if it has SHORT characters or more
and a key word stands in the REACH characters before it on its line; any other token is O. A token that must be O cuts a
chain in two independent ones, so the text falls into chains of free tokens with nothing but white space between
them, and decoding these one by one is decoding the whole text.

The field is trained in numpy, once per process, on lines made by a seeded generator. Real tables label no secrets, and
made lines keep the model the same for every table, partition and retry.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, texts


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns, in the order of their kinds, and the least length of what they catch.
KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = re.compile(rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 and more
KINDS = ("assign", "access", "hex", "crf")

#: Free tokens: of LONG characters by their look, of SHORT ones with a key word at most REACH characters before.
LONG, SHORT, REACH = 12, 8, 60
#: What is left of a tagged token beside a base span counts from this length on.
LEFT = 6
TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]+={0,2}")
LOOK = re.compile(r"[A-Za-z0-9+/_.~-]{%d,}={0,2}" % LONG)
_DIGIT = re.compile(r"[0-9]").search
_MIXED = re.compile(r"[a-z][A-Z]+[a-z]+[A-Z]|[A-Z][a-z]+[A-Z]{2,}[a-z]").search

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each base pattern, without those that are too short."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


KEY_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private")
_NEAR_KEY = re.compile("|".join(map(_any_case, KEY_STEMS)))
_WORD = re.compile(r"[A-Za-z_]+")
_ISSUED = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk[_-]|pk_live|rk_live|xox[abprs]-|AIza|eyJ|ya29\.|npm_|pypi-|shpat_|SG\.|hf_)")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NUMBER = re.compile(r"[0-9.+/_=~-]+")
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6}[./]*")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDY = re.compile(r"[A-Za-z]{2,}[._/-]")


_KIND = str.maketrans({chr(c): "l" if chr(c).islower() else "u" if chr(c).isupper() else "d" if chr(c).isdigit() else "s" for c in range(128)})
_NO_DIGIT = str.maketrans("lus", "xxx")


def shape(token: str) -> list[str]:
    """What a token looks like."""
    n = len(token)
    kinds = token.translate(_KIND)
    lower, upper, digits, signs = map(kinds.count, "luds")
    flat = kinds.translate(_NO_DIGIT)
    turns, cases = flat.count("xd") + flat.count("dx"), kinds.count("lu")
    vowels = sum(map(token.count, "aeiouyAEIOUY"))
    times = Counter(token)
    entropy = -sum(k / n * math.log2(k / n) for k in times.values())
    out = [f"len{min(n // 8, 6)}", f"entropy{min(int(entropy * 2), 10)}", f"turns{min(turns // 2, 5)}", f"digits{digits * 4 // n}", f"cases{min(cases * 8 // n, 3)}", f"vowels{min(vowels * 8 // max(1, n - digits - signs), 4)}"]
    out += [name for name, ok in (
        ("lower", lower), ("upper", upper), ("mixed", lower and upper and digits), ("signs", signs > 2),
        ("hex", _HEX.fullmatch(token)), ("number", _NUMBER.fullmatch(token)), ("host", _HOST.fullmatch(token)), ("uuid", _UUID.fullmatch(token)),
        ("issued", _ISSUED.match(token)), ("wordy", _WORDY.search(token)), ("letters", lower + upper == n), ("capitals", upper == n), ("name", lower and not upper and not digits), ("even64", n == 64), ("padded", token.endswith("=")),
    ) if ok]
    return out


def neighbourhood(text: str, start: int, end: int) -> list[str]:
    """What stands around a token: the two words before it on its line and the one after it, and the signs beside it."""
    line = text.rfind("\n", max(0, start - REACH), start)
    before = text[max(line + 1, start - REACH) : start]
    after = text[end : end + REACH]
    out = [f"before{k + 1}={w.lower()}" for k, w in enumerate(reversed(_WORD.findall(before)[-2:]))]
    if (m := _WORD.search(after)) and "\n" not in after[: m.start()]:
        out.append(f"after={m[0].lower()}")
    if m := list(_NEAR_KEY.finditer(before)):
        out.append("key_near" if len(before) - m[-1].end() <= 12 else "key_far")
    tail = before.rstrip(" ")[-3:]
    out += [name for name, ok in (
        ("assigned", tail[-1:] in (":", "=") or tail[-1:] in ("'", '"') and ("=" in tail or ":" in before[-5:])), ("quoted", tail[-1:] in ("'", '"', "`")),
        ("host_part", text[max(0, start - 1) : start] == "@" or after[:1] == "@"), ("url", before.endswith("//") or "://" in before[-30:] and " " not in before.rpartition("://")[2]),
        ("line_start", not before.strip()), ("close_quote", after[:1] in ("'", '"', "`")),
    ) if ok]
    return out


def file_features(text: str) -> list[str]:
    """What kind of file it is."""
    lines = text.count("\n") + 1
    out = ["file_config"] if text.count("=") * 2 > lines else []
    if "-----BEGIN" in text:
        out.append("file_pem")
    return out


def key_ends(text: str) -> list[int]:
    """Where key words end, in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter grew: places would be off
        return [m.end() for m in _NEAR_KEY.finditer(text)]
    out = []
    for stem in KEY_STEMS:
        at = low.find(stem)
        while at >= 0:
            out.append(at + len(stem))
            at = low.find(stem, at + 1)
    return sorted(out)


def free_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that may be other than O, in text order."""
    found = {m.span() for m in LOOK.finditer(text) if _DIGIT(m[0]) or _MIXED(m[0])}
    done = 0
    for end in key_ends(text):
        line = text.find("\n", end, end + REACH)
        stop = line if line >= 0 else end + REACH
        for t in TOKEN.finditer(text, max(done, end)):
            a, b = t.span()
            if a >= stop:
                break
            done = b
            if b - a >= SHORT and (a > end or not TOKEN.match(text, a - 1)):
                found.add((a, b))
    out = []
    for a, b in sorted(found):
        while b > a and text[b - 1] in ".-~":  # ends of sentences, rules and ranges
            b -= 1
        if b - a >= SHORT and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Free tokens, as runs with nothing but white space between their tokens."""
    out: list[list[tuple[int, int]]] = []
    for a, b in free_tokens(text):
        if out and text[out[-1][-1][1] : a].isspace():
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


O, B, I = 0, 1, 2  # noqa: E741
_FORBIDDEN = np.zeros((3, 3))
_FORBIDDEN[O, I] = -1e4


@dataclass
class Field:
    """A linear-chain conditional random field; chains begin and end in O."""

    names: dict[str, int]
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # 3 x 3

    def emissions(self, chain: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[k for f in token if (k := self.names.get(f)) is not None]].sum(0) for token in chain])

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        moves, own = self.moves + _FORBIDDEN, self.emissions(chain)
        score, back = moves[O] + own[0], []
        for e in own[1:]:
            through = score[:, None] + moves
            back.append(through.argmax(0))
            score = through.max(0) + e
        y = int((score + moves[:, O]).argmax())
        out = [y]
        for k in reversed(back):
            y = int(k[y])
            out.append(y)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


#: Features seen less often in training are left out.
LEAST_SEEN = 4


def fit(examples: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent with forward-backward, over all chains of a length at once."""
    times = Counter(f for chain, _ in examples for token in chain for f in token)
    names = {f: k for k, f in enumerate(sorted(f for f, n in times.items() if n >= LEAST_SEEN))}
    field = Field(names, np.zeros((len(names), 3)), np.zeros((3, 3)))
    packs = []
    for length in sorted({len(y) for _, y in examples}):
        same = [(c, y) for c, y in examples if len(y) == length]
        x = np.zeros((len(same), length, len(names)))
        for k, (chain, _) in enumerate(same):
            for t, token in enumerate(chain):
                x[k, t, [names[f] for f in token if f in names]] = 1
        packs.append((x, np.eye(3)[np.array([y for _, y in same])]))
    square_w, square_m = np.full_like(field.weights, 1e-8), np.full_like(field.moves, 1e-8)
    for _ in range(rounds):
        up_w, up_m = -ridge * len(examples) * field.weights, -ridge * len(examples) * field.moves
        moves = field.moves + _FORBIDDEN
        for x, y in packs:
            own = x @ field.weights
            ahead = [moves[O] + own[:, 0]]
            for t in range(1, own.shape[1]):
                ahead.append(_log_sum(ahead[-1][:, :, None] + moves, 1) + own[:, t])
            behind = [np.broadcast_to(moves[:, O], (len(x), 3))]
            for t in range(own.shape[1] - 1, 0, -1):
                behind.append(_log_sum(moves + (own[:, t] + behind[-1])[:, None, :], 2))
            behind.reverse()
            total = _log_sum(ahead[-1] + moves[:, O], 1)
            chance = np.stack([np.exp(a + b - total[:, None]) for a, b in zip(ahead, behind, strict=True)], 1)
            up_w += np.einsum("ntf,nty->fy", x, y - chance)
            up_m[O] += (y[:, 0] - chance[:, 0]).sum(0)
            up_m[:, O] += (y[:, -1] - chance[:, -1]).sum(0)
            for t in range(1, own.shape[1]):
                pair = np.exp(ahead[t - 1][:, :, None] + moves + (own[:, t] + behind[t])[:, None, :] - total[:, None, None])
                up_m += np.einsum("na,nb->ab", y[:, t - 1], y[:, t]) - pair.sum(0)
        square_w += up_w**2
        square_m += up_m**2
        field.weights += rate * up_w / np.sqrt(square_w)
        field.moves += rate * up_m / np.sqrt(square_m)
    return field


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def made_lines(seed: int = 11, count: int = 3000) -> list[tuple[str, list[tuple[int, int]]]]:
    """Small texts and the secrets in them: each secret is a list of its tokens' spans, in text order."""
    r = random.Random(seed)
    of = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    word = lambda: of(LETTERS, 2, 9)
    words = lambda: " ".join(word() for _ in range(r.randint(1, 8)))
    alnum = LETTERS + LETTERS.upper() + DIGITS
    secret = lambda: r.choice([lambda: of(alnum, 16, 48), lambda: of(alnum + "+/", 30, 60) + "=", lambda: of("0123456789abcdef", 24, 64), lambda: r.choice(["ghp_", "glpat-", "sk_live_", "sk-", "xoxb-", "AIza", "hf_", "npm_"]) + of(alnum, 20, 40), lambda: "eyJ" + of(alnum, 16, 30) + "." + of(alnum, 20, 60) + "." + of(alnum + "_-", 20, 43)])()
    lettered = lambda: r.choice([lambda: of(LETTERS + LETTERS.upper(), 16, 44), lambda: of(LETTERS.upper(), 16, 32), lambda: of(LETTERS, 20, 40)])()
    short = lambda: of(LETTERS, 2, 6) + r.choice("!._-+") .replace("!", "") + of(DIGITS, 2, 4) + of(alnum, 3, 8)
    names = ["password", "db_password", "secret", "client_secret", "token", "auth_token", "api_key", "apiKey", "access_key", "SECRET_KEY", "private_key", "credential", "API key", "auth token", "access token"]
    around = [lambda n, s: f'{n} = "{s}"', lambda n, s: f"export {n.upper()}={s}", lambda n, s: f'"{n}": "{s}"', lambda n, s: f"Authorization: Bearer {s}", lambda n, s: f"{n}: {s}", lambda n, s: f"{words()} {n} {s} {words()}", lambda n, s: f"the {n} is {s}"]
    issued = lambda: r.choice(["ghp_", "glpat-", "sk_live_", "xoxb-", "AIza", "hf_", "npm_"]) + of(alnum, 24, 40)
    harmless = [
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: of(DIGITS, 12, 19), lambda: f"mail{r.randint(1, 9)}.{word()}.com",
        lambda: f"20{of(DIGITS, 2, 2)}-{of(DIGITS, 2, 2)}-{of(DIGITS, 2, 2)}T{of(DIGITS, 2, 2)}", lambda: f"{word()}/{word()}_{r.randint(1, 99)}.{r.choice(['py', 'txt', 'html'])}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{word()}", lambda: "-".join(of("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: of("0123456789abcdef", 40, 40),
        lambda: f"{word()}-{word()}-{r.randint(1, 999)}-{word()}", lambda: f"{word()}{r.randint(1, 9)}_{word()}_{word()}", lambda: f"www.{word()}{r.randint(1, 9)}.org/{word()}", lambda: word() + word() + of(DIGITS, 1, 2), lambda: word() + word() + word(), lambda: word().title() + word().title() + word().title(), lambda: word() + "-" + word() + "-" + word(),
        lambda: word().upper() + word().upper() + word().upper(),
    ]
    out = []
    for _ in range(count):
        kind = r.random()
        if kind < 0.4:
            s = r.choices([secret, lettered, short, issued], [8, 2, 1, 1])[0]()
            bare = s.startswith(("ghp_", "glpat-", "sk_live_", "xoxb-", "AIza", "hf_", "npm_", "eyJ")) and r.random() < 0.5
            line = f"{r.choice(['', words() + ' '])}{s}" if bare else r.choice(around)(r.choice(names), s)
            text = r.choice(["", words() + "\n"]) + line + r.choice(["", "\n" + words()])
            at = text.index(s)
            out.append((text, [(at, at + len(s))]))
        elif kind < 0.45:
            block = [of(alnum + "+/", 64, 64) for _ in range(r.randint(2, 5))] + [of(alnum + "+/", 20, 50) + "="]
            text = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(block) + "\n-----END PRIVATE KEY-----\n"
            spans, at = [], 0
            for b in block:
                at = text.index(b, at)
                spans.append((at, at + len(b)))
                at += len(b)
            out.append((text, spans))
        else:
            text = " ".join(x for _ in range(r.randint(1, 3)) for x in (words(), r.choice(["", "", "id ", "commit ", "from ", "card ", "see https://", "a@", "key points: ", "the key to ", "a token of ", "secret of the ", "passing ", "the author of ", "its authority over "]) + r.choice(harmless)(), words()))
            out.append((text, []))
    return out


def described(text: str, chain: list[tuple[int, int]], file: list[str]) -> list[list[str]]:
    return [[*shape(text[a:b]), *neighbourhood(text, a, b), *file, "any"] for a, b in chain]


@lru_cache(maxsize=1)
def trained() -> Field:
    examples = []
    for text, secrets in made_lines():
        file, starts = file_features(text), {a for a, _ in secrets}
        for chain in chains(text):
            inside = [a in starts for a, _ in chain]
            labels = [(I if k and inside[k - 1] else B) if own else O for k, own in enumerate(inside)]
            examples.append((described(text, chain, file), labels))
    return fit(examples)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without what isn't of the secret alphabet at its ends."""
    while a < b and not TOKEN.match(text, a, b):
        a += 1
    while a < b and not (text[b - 1] == "=" or TOKEN.match(text, b - 1, b)):
        b -= 1
    return a, b


def beside(text: str, tagged: list[tuple[int, int]], taken: list[Span]) -> list[Span]:
    """What is left of tagged spans outside the base spans: one sweep over both, which come by start."""
    out: list[Span] = []
    at = 0
    for start, end in tagged:
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        begin, pieces, k = start, [], at
        while k < len(taken) and taken[k][1] < end:
            if taken[k][1] > begin:
                pieces.append((begin, taken[k][1]))
            begin, k = max(begin, taken[k][2]), k + 1
        if begin < end:
            pieces.append((begin, end))
        for a, b in pieces:
            if (a, b) != (start, end):
                a, b = trimmed(text, a, b)
            if b - a >= LEFT:
                out.append(("crf", a, b))
    return out


def tagged_spans(text: str, taken: list[Span]) -> list[Span]:
    """Secrets that the field finds outside the base spans. A secret of several tokens is one span, cut by base spans."""
    tagged: list[tuple[int, int]] = []
    file = None
    field = trained()
    for chain in chains(text):
        if file is None:
            file = file_features(text)
        for (a, b), y in zip(chain, field.decode(described(text, chain, file)), strict=True):
            if y == I:
                tagged[-1] = (tagged[-1][0], b)
            elif y == B:
                tagged.append((a, b))
    return beside(text, tagged, merged(taken))


def merged(taken: list[Span]) -> list[Span]:
    """Spans by start, overlapping ones joined."""
    out: list[Span] = []
    for kind, a, b in taken:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by start and then kind (code points, end exclusive)."""
    base = base_spans(text)
    return base, sorted(base + tagged_spans(text, base), key=order)


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[Span], mark: str = "<secret>") -> str:
    """The text with every span replaced; overlapping spans are one."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: s[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row; a null text is an empty one."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)[1]] for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    One row out for each row in, in any order; rows that repeat a doc_id or a text are scanned each. A null text is an
    empty one, a null doc_id stays null; an empty table gives an empty result. Texts of any length are scanned whole, in
    time linear in their length. Of spans with one start the kinds come as listed. Other columns, whatever their names, are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [spans(t) for t in texts(batch)]
        count = lambda kind: pa.array([sum(s[0] == kind for s in found) for _, found in both], pa.int64())
        arrays = [batch.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]), pa.array([written(found) for _, found in both]), count("crf")]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The table with every secret in its text replaced by <secret>; a null text stays null, an empty one empty.

    Other columns stay as they are, whatever their names, and so do the number of rows, repeated ones and an empty table.
    Overlapping spans, of one kind or of several, are replaced by one mark.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        new = [None if t is None else redacted(t, spans(t)[1]) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)
