"""The pipeline's stages against brute-force versions of each."""

import hashlib

import corpus_pipeline as cp
from larkspur.llm import ngram_join, secrets, toxicity

from .conftest import LONG
from .test_operators import brute_components, brute_score, by_id, lower, near_copies


def test_pipeline(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, LONG, "en", "a", 1), (9004, "My api_key = ABCDEFGHIJKLMNOPQRSTUV is here.", "en", "a", 1), (9004, "My api_key = ABCDEFGHIJKLMNOPQRSTUV is here.", "en", "a", 1)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    whole = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = [whole]
    for _, stage in cp.STAGES:
        kept.append(stage(spark, kept[-1], d).cache())
    assert [k for k, _ in cp.STAGES] == ["toxicity", "near copies", "secrets", "mixing", "encoding"]
    assert all(df.columns == whole.columns and df.schema["n_chars"].dataType == whole.schema["n_chars"].dataType for df in kept[1:-1])

    model = toxicity.fit(whole, labels)
    clean = [r for r in whole.collect() if brute_score(model, r.text or "") < model.thresholds.get(r.lang, 0.5)]
    assert sorted(map(str, clean)) == sorted(map(str, kept[1].collect())) and 0 < len(clean) < whole.count()

    brute = brute_components({r.doc_id: r.text for r in clean})
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(i for i, (_, c) in brute.items() if i == c)

    texts = {r.doc_id: r.text for r in kept[2].collect()}
    for r in kept[3].collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else secrets.redacted(t, secrets.spans(t)[1])) and (t is None or r.n_chars == len(r.text))
        assert "ABCDEFGHIJKLMNOPQRSTUV" not in (r.text or "")

    redacted = {r.doc_id: r.text for r in kept[3].collect()}
    assert all(redacted[r.doc_id] == r.text for r in kept[4].collect()) and 0 < kept[4].count() < kept[3].count()
    last = by_id(kept[5])
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in ((r.doc_id, r.text) for r in kept[4].collect())} == {i: r.decoded_sha256 for i, r in last.items()}
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, last.values()))


def test_near_copies_are_five_words_and_80_percent(spark):
    """A tail of a fifth of a text's length makes a near copy; the kept rows are those of a comparison of all pairs."""
    words = [f"w{k}" for k in range(120)]
    rows = list(near_copies().items()) + [(1000, " ".join(words[:100])), (1001, " ".join(words))]
    sets, up = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in up:
        for j in up:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in cp.near_copies(spark, docs, "").collect())
    assert kept == sorted(i for i in up if root(i) == i) and 1000 in kept and 1001 not in kept


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert ngram_join.BLOCK > 0
