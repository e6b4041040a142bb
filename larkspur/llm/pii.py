"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Native throughout.

The patterns are written so that a scan is linear even in a megabyte without white space: a match can only begin at a
run's begin or where the last match ended (\\G), and quantifiers that need no way back are possessive. They match what
the plain patterns in their comments match. Places come from the pieces between the matches, whose lengths are summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # an SQL condition on text, cheap and true wherever the pattern matches
    valid: str  # an SQL condition on hit
    words: str  # context words that raise the score
    score: float


_DIGITS = "regexp_replace(hit, '[^0-9]', '')"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Luhn: from the right, every second digit is doubled, and the digits of all are summed.
_LUHN = f"""aggregate(transform(reverse(split({_DIGITS}, '')), (d, k) -> cast(d as int) * (1 + k % 2)), 0L, (a, x) -> a + x div 10 + x % 10) % 10 = 0"""
#: ISO 7064 mod 97-10: the first four characters go to the end, letters become 10 to 35, the number leaves 1.
_MOD97 = """aggregate(split(concat(substr(hit, 5), substr(hit, 1, 4)), ''), 0,
    (a, c) -> case when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"""

KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", "mail|email|e-mail|contact|write|reach|from|to", 0.8),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'", rf"hit rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'", "ip|host|address|server|login|node", 0.5),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", r"text rlike r'(?:[0-9][\x20-]?){15}[0-9]'", f"length({_DIGITS}) between 16 and 19 and {_LUHN}", "card|visa|mastercard|credit|debit|pay|payment", 0.7),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) between 8 and 15", "phone|tel|telephone|call|mobile|fax", 0.6),
)
#: What the method adds: account numbers.
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2}[A-Z0-9]{11}'", _MOD97, "iban|account|bank|transfer", 0.9)
#: How much a context word within CONTEXT characters of a span adds, and the score from which a span is flagged.
CONTEXT, BONUS, FLAGGED = 40, 0.2, 0.6
#: What is no letter, digit or other character of a word.
EDGE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CHUNK = 256


def running_sum(name: str) -> Column:
    """Running sums of an array column of longs, by chunks: long arrays take little more than linear time."""
    chunks = f"transform(sequence(1, size({name}), {CHUNK}), b -> slice({name}, b, {CHUNK}))"
    totals = f"transform({chunks}, c -> aggregate(c, 0L, (a, x) -> a + x))"
    grow = "(a, x) -> named_struct('s', a.s + x, 'o', concat(a.o, array(a.s + x)))"
    none = "cast(array() as array<bigint>)"
    bases = f"aggregate({totals}, named_struct('s', 0L, 'o', {none}), (a, x) -> named_struct('s', a.s + x, 'o', concat(a.o, array(a.s))), a -> a.o)"
    return F.expr(f"if(size({name}) = 0, {none}, flatten(zip_with({chunks}, {bases}, (c, base) -> aggregate(c, named_struct('s', base, 'o', {none}), {grow}, a -> a.o))))")


def near(hits: str, gaps: str) -> str:
    """SQL of what stands around each hit, A-Z lower-cased: the ends of the two gaps before it and the begins of the two
    after it, CONTEXT characters on each side. Spaces stand for hits and for both ends of the text."""
    before = f"right(concat(coalesce(get({gaps}, k - 1).tail, ''), get({gaps}, k).tail), {CONTEXT})"
    after = f"left(concat(coalesce(get({gaps}, k + 1).head, ''), coalesce(get({gaps}, k + 2).head, '')), {CONTEXT})"
    return f"transform({hits}, (h, k) -> translate(concat({before}, ' ', {after}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def pii_spans(docs: DataFrame, kinds: tuple[Kind, ...] = (*KINDS, IBAN)) -> DataFrame:
    """doc_id and, for each kind, an array column of its name: confirmed spans by start, as (start, end, score).

    Starts and ends are code points, ends exclusive. A null text is an empty one.
    """
    out = narrow(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    for k in kinds:
        pattern = "r'" + k.pattern + "'"
        hits = f"if({k.guard}, regexp_extract_all(text, {pattern}, 0), cast(array() as array<string>)) as {k.name}_hits"
        gaps = f"if({k.guard}, transform(split(text, {pattern}, -1), g -> named_struct('n', cast(length(g) as bigint), 'tail', right(concat(' ', right(g, {CONTEXT})), {CONTEXT}), 'head', left(concat(left(g, {CONTEXT}), ' '), {CONTEXT}))), array()) as {k.name}_gaps"
        out = out.selectExpr("*", hits, gaps)
    out = out.drop("text")
    for k in kinds:
        out = out.withColumn(f"{k.name}_steps", F.expr(f"zip_with({k.name}_gaps.n, concat(array(0L), transform({k.name}_hits, h -> cast(length(h) as bigint))), (g, h) -> coalesce(g, 0L) + coalesce(h, 0L))")).withColumn(f"{k.name}_near", F.expr(near(f"{k.name}_hits", f"{k.name}_gaps")))
    for k in kinds:
        out = out.withColumn(f"{k.name}_starts", running_sum(f"{k.name}_steps"))
    for k in kinds:
        hit, start, around = (f"s.{k.name}_{x}" for x in ("hits", "starts", "near"))
        zipped = f"arrays_zip({k.name}_hits, {k.name}_starts, {k.name}_near)"
        score = f"least(1D, {k.score}D + if({around} rlike r'{EDGE}(?:{k.words}){EDGE}', {BONUS}D, 0D))"
        spans = f"transform(filter({zipped}, s -> {hit} is not null and {k.valid.replace('hit', hit)}), s -> named_struct('start', {start}, 'end', {start} + length({hit}), 'score', {score}))"
        out = out.withColumn(k.name, F.expr(spans))
    return out.select("doc_id", *[k.name for k in kinds])


def written(kinds: tuple[Kind, ...]) -> Column:
    """All spans as kind:start:end, by kind as listed and then start, comma-joined."""
    parts = ", ".join(f"transform({k.name}, s -> concat('{k.name}:', s.start, ':', s.`end`))" for k in kinds)
    return F.expr(f"array_join(concat({parts}), ',')")


def pii_scan(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, score (the highest of a span, or 0), n_flagged.

    n_flagged counts the spans of a score of FLAGGED or more: an address of a network alone isn't, near a context word it is.
    One row out for each row in, in any order; rows that repeat a doc_id or a text are scanned each. A null text is an
    empty one, a null doc_id stays null, an empty table gives an empty result. Texts of any length are scanned whole. Other
    columns, whatever their names, are ignored.
    """
    scores = "concat(" + ", ".join(f"{k.name}.score" for k in (*KINDS, IBAN)) + ")"
    return pii_spans(docs).select(
        "doc_id", *[F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in KINDS], F.sha2(written(KINDS), 256).alias("base_sha256"),
        written((*KINDS, IBAN)).alias("spans"), F.size("iban").cast("bigint").alias("n_iban"), F.expr(f"coalesce(array_max({scores}), 0D)").alias("score"),
        F.expr(f"cast(size(filter({scores}, x -> x >= {FLAGGED}D)) as bigint)").alias("n_flagged"),
    )
