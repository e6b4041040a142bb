from larkspur.operators import store as st


def cells(spark, **values):
    return spark.createDataFrame(list(values.items()), "key string, value string")


def live(table):
    return {r.key: r.value for r in table.snapshot().collect()}


def test_latest_wins_and_deletes(spark, tmp_path):
    table = st.Table(spark, str(tmp_path / "t"), compact_after=3)
    assert live(table) == {} and table.get("a") is None
    table.write(cells(spark, a="1", b="2", c="3"))
    table.write(cells(spark, d="4", a="5", c=None))
    assert live(table) == {"a": "5", "b": "2", "d": "4"} and table.get("c") is None
    table.write(cells(spark, e="6"))
    assert table.compacted_at() == 4  # the generations before it stay for plans that read them
    again = st.Table(spark, str(tmp_path / "t"))
    assert live(again) == {"a": "5", "b": "2", "d": "4", "e": "6"} and again.next_seq() == 4
    assert again.changes().where("key = 'c' and op = 'del'").count() == 1  # deletions outlive compaction


def test_half_written_generations_are_ignored(spark, tmp_path):
    table = st.Table(spark, str(tmp_path / "t"))
    table.write(cells(spark, a="1"))
    (tmp_path / "t" / "gen=9").mkdir()
    (tmp_path / "t" / "gen=x").mkdir()
    assert table.generations() == [1] and live(table) == {"a": "1"}


def test_unknown_op_fails(spark):
    import pytest

    with pytest.raises(Exception, match="unknown op"):
        st.latest(spark.createDataFrame([(1, "merge", "a", "1")], st.CHANGE)).collect()


def test_replication(spark):
    rows = [("n1", 1), ("n1", 2), ("n1", 2), ("n1", 4), ("n2", 1)]
    applied = spark.createDataFrame([(n, i, k, "put", "k", str(k)) for k, (n, i) in enumerate(rows)], "node_id string, idx bigint, arrival int, op string, key string, value string")
    assert [tuple(r) for r in st.replication_gaps(applied).collect()] == [("n1", 3, 4)]
    assert sorted((r.node_id, r.idx, r.value) for r in st.applicable(applied).collect()) == [("n1", 1, "0"), ("n1", 2, "1"), ("n2", 1, "4")]
