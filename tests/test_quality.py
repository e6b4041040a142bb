from larkspur.operators import quality as ql

ROWS = [("1", "purchase", "3.5", "10", 0), (None, "click", None, "11", 1), ("2", "refund", "-5", "x", 2), (" ", " CLICK ", "abc", None, 3)]
SCHEMA = "user_id string, event_type string, amount string, timestamp string, pos bigint"


def test_issues(spark):
    checked = ql.validated(spark.createDataFrame(ROWS, SCHEMA), require_timestamp=True)
    got = [(r["index"], r.field, r.message) for r in ql.issue_rows(checked).orderBy("index").collect()]
    kinds = "event_type must be one of ['add_to_cart', 'click', 'purchase', 'view']"
    assert sorted(got) == sorted([
        (1, "user_id", "user_id is required"), (2, "event_type", kinds), (2, "timestamp", "timestamp must be numeric"), (2, "amount", "amount must be non-negative"),
        (3, "user_id", "user_id is required"), (3, "timestamp", "timestamp is required"), (3, "amount", "amount must be numeric"),
    ])
    totals = ql.quality_totals(checked).first()
    assert (totals.total_count, totals.valid_count, totals.invalid_count, totals.ok) == (4, 1, 3, False)
    assert [r.user_id for r in ql.valid_events(checked).collect()] == ["1"]


def test_no_rows(spark):
    totals = ql.quality_totals(ql.validated(spark.createDataFrame([], SCHEMA))).first()
    assert (totals.total_count, totals.issue_count, totals.ok) == (0, 0, True)
