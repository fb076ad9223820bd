"""The pipeline's stages on a small table, and its queries' registration."""

import corpus_pipeline
from conftest import DATA
from test_operators import corpus, linked, shingle_sets, windows  # noqa: F401

import __spark_entry__
from glyphlake.llm.common import materialise


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 !!", "en", "s", 5), (9003, "", "en", "s", 0)], docs.schema)
    docs, before = docs.unionByName(extra), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001").cache()
        if name != "mixture":
            assert out.columns == docs.columns and out.count() <= docs.count()
        if name == "language":
            assert out.where("doc_id > 9000").count() == 0 and out.count() == docs.count() - 3
        if name == "near_duplicates":
            assert out.select("text").distinct().count() == out.count()
        before, docs = docs, out
    assert docs.count() == before.count() and {"doc_id", "size", "source_size", "target", "taken"} <= set(docs.columns)


def test_stages_equal_plain_versions(spark, corpus):  # noqa: F811
    """Each stage on all that the one before kept."""
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()]
    more = [f"{corpus[20]} {items[0]} {corpus[21]}", "1 2 3", f"{items[1]}"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*corpus, *more])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    texts = {i: t for i, t, *_ in rows}
    got = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, f"{DATA}/sf0.001"), "test")
        got.append({r["doc_id"]: r for r in docs.collect()})
    texts = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert {i: r["text"] for i, r in got[0].items()} == texts
    ids = sorted(texts)
    component = linked(shingle_sets([texts[i] for i in ids]))
    texts = {i: texts[i] for i, c in zip(ids, component) if ids[c] == i}
    assert {i: r["text"] for i, r in got[1].items()} == texts
    ids = sorted(texts)
    marks = windows([texts[i].encode() for i in ids], 200)
    texts = {i: bytes(b for b, gone in zip(texts[i].encode(), m) if not gone).decode("utf-8", "ignore") for i, m in zip(ids, marks)}
    texts = {i: t for i, t in texts.items() if t.encode().split()}
    assert {i: (r["text"], r["n_chars"]) for i, r in got[2].items()} == {i: (t, len(t)) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not any(x in t for x in items)}
    assert {i: r["text"] for i, r in got[3].items()} == texts and len(got[2]) == len(got[3]) + 2
    assert {i: r["size"] for i, r in got[4].items()} == {i: len(t.encode().split()) for i, t in texts.items()}
    for s in {r["source"] for r in got[4].values()}:
        own = [r for r in got[4].values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)
