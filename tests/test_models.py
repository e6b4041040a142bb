"""Scorers against known predictions."""

from larkspur.operators import attention as at
from larkspur.operators import features as ft
from larkspur.operators import intent
from larkspur.operators import sequences as sq
from larkspur.operators.catalog import DEFAULTS, Registry
from larkspur.sources.events import EVENT, file_or_sample, sample_events


def test_sample_sequence_model(spark, tmp_path):
    events = sample_events(spark)
    found = sq.stratified_split(sq.examples(events)).cache()
    vocab = sq.vocabulary(found).cache()
    assert found.count() == 22 and vocab.count() == 17
    model = at.AttentionModel()
    fitted = model.fit(found.where("not is_test"), vocab)
    m = at.evaluate(model.predict(found.where("is_test"), vocab, fitted)).first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.tp, m.tn, m.fp, m.fn) == (0.6667, 0.3333, 1.0, 0.5, 1, 3, 2, 0)
    at.save(fitted, model, str(tmp_path), spark)
    model, fitted = at.load(str(tmp_path), spark)
    nobody = spark.createDataFrame([(-1, "999", [], 0)], "pos bigint, user_id string, tokens array<string>, label int")
    asked = at.asked_from_events(events).where("user_id < '4'").union(nobody)
    sq.save_vocabulary(vocab, str(tmp_path / "vocabulary"))
    vocab = sq.load_vocabulary(spark, str(tmp_path / "vocabulary"))
    got = {r.user_id: r for r in model.predict(asked, vocab, fitted).collect()}
    assert {u: r.purchase_probability for u, r in got.items()} == {"0": 0.7051, "1": 0.9891, "2": 0.1292, "3": 0.8886, "999": 0.25}
    assert got["999"].important == [] and len(got["0"].important) == 5


def test_encoding(spark):
    found = spark.createDataFrame([(0, 0, 0, ["event:view"]), (1, 0, 1, ["a", "b", "c", "event:view"])], "pos bigint, user_first bigint, timestamp bigint, tokens array<string>")
    vocab = sq.vocabulary(found.where("pos = 0"))
    assert {r.pos: r.ids for r in sq.encoded(found, vocab, 3).collect()} == {0: [0, 0, 2], 1: [1, 1, 2]}


def test_intent_figures(spark):
    batch = [("0", "click")] * 8 + [("0", "purchase", 20.0)] * 3 + [("1", "click")] * 5 + [("1", "purchase", 12.0)] + [("2", "click")] * 3
    events = spark.createDataFrame([(u, t, a[0] if a else None, 0, None, k) for k, (u, t, *a) in enumerate(batch)], EVENT)
    stream = [("0", "click", None, t) for t in (1, 15, 70, 130, 190)] + [("0", "purchase", 10.0, t) for t in (75, 210)] + [("1", "click", None, t) for t in (5, 65, 125)]
    windows = spark.createDataFrame([(*r, None, k) for k, r in enumerate(stream)], EVENT)
    users = spark.createDataFrame([("0",), ("1",), ("2",), ("999",)], "user_id string")
    served = ft.served_features(users, ft.user_features(events), ft.window_features(windows), [0, 60, 120, 180, 240])
    got = {r.user_id: r for r in intent.IntentModel().predict(served).collect()}
    assert (got["0"].purchase_probability, got["0"].confidence, got["0"].label) == (0.9953, 1.0, "likely_to_purchase")
    assert (got["999"].purchase_probability, got["999"].confidence, got["999"].label) == (0.0989, 0.32, "uncertain")
    assert {u: (r.purchase_probability, r.confidence) for u, r in got.items()} == {"0": (0.9953, 1.0), "1": (0.5125, 1.0), "2": (0.1483, 0.56), "999": (0.0989, 0.32)}
    assert got["999"].warnings[-1] == "no_recent_stream_activity" and got["2"].confidence == 0.56
    audit = intent.audit(intent.IntentModel().predict(served).where("false")).first()
    assert tuple(audit) == (0, 0.0, 0.0)


def test_registry():
    registry = Registry.default()
    assert len(registry.listed()) == len(DEFAULTS) == 10 and [f.name for f in registry.listed("model")] == ["prediction_label", "purchase_probability"]
    try:
        registry.register(DEFAULTS[0])
        raise AssertionError
    except ValueError:
        pass


def test_csv_source(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("timestamp,visitorid,event,itemid\n5.0,7,transaction,9\n6,8, AddToCart,1\n")
    rows, label = file_or_sample(spark, str(path))
    assert label == str(path) and [(r.user_id, r.event_type, r.timestamp) for r in rows.orderBy("timestamp").collect()] == [("7", "purchase", 5), ("8", "add_to_cart", 6)]
    assert file_or_sample(spark, str(tmp_path / "none.csv"))[0].count() == 31
