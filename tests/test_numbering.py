"""Numbers over many buckets against sorting in one place."""

import random

from larkspur.operators import numbering
from larkspur.operators.numbering import numbered


def expected(rows, by, order):
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in (*by, *order))):
        g = tuple(r[c] for c in by)
        seen[g] = seen.get(g, 0) + 1
        out[r["pos"]] = seen[g]
    return out, seen


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(numbering, "EACH", 5)
    rng = random.Random(3)
    rows = [{"g": rng.choice(["a", "a", "a", "b", None]), "t": rng.choice([None, 1, 1, 1, 2, 7]), "pos": k, "text": rng.choice(["é", "z", "\U0001f600", ""])} for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, pos bigint, text string")
    for by, order in (((), ("t", "pos")), (("g",), ("text", "t", "pos")), ((), ("pos",))):
        assert len(numbering._bounds(df, [*by, *order])) == 7
        want, sizes = expected(rows, by, order)
        got = numbered(df, order, "_at", by=by, total="_of").collect()
        assert {r.pos: r["_at"] for r in got} == want and len(got) == 2000
        assert all(r["_of"] == sizes[tuple(r[c] for c in by)] for r in got)
        assert got[0].asDict().keys() == {"g", "t", "pos", "text", "_at", "_of"}


def test_equal_rows_and_empty(spark, monkeypatch):
    monkeypatch.setattr(numbering, "EACH", 5)
    same = spark.createDataFrame([(1,)] * 500, "pos bigint")
    assert sorted(r.n for r in numbered(same, ["pos"], "n").collect()) == list(range(1, 501))
    assert numbered(same.where("false"), ["pos"], "n").count() == 0


def test_no_task_sorts_all(spark, monkeypatch):
    monkeypatch.setattr(numbering, "EACH", 5)
    df = numbered(spark.range(1000).withColumnRenamed("id", "pos"), ["pos"], "n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_numbering_bucket" in plan
