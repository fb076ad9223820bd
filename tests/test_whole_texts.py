"""Queries that take whole texts and all rows, on texts at and over the limits."""

import duckdb
import pytest

from glyphlake import formats as K
from glyphlake.plans import carriers, catalog


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents 1 to 21 and turns with long texts; document 4 just fits a JPEG segment, 7 is a byte over."""
    d = tmp_path_factory.mktemp("long")
    fits = K.SEGMENT_CAP - 2 - 4 - len(K.JPEG_IDENT) - 16 - carriers._ABOUT - len(carriers._HEAD + carriers._TAIL) - len(',"text":""')
    texts = {4: "x" * fits, 7: "x" * (fits + 1), 8: "é" * 70_000, 9: "y" * 70_000, 10: 'a"b\\c\n\t/\u0001é₹' * 300, 11: None, 12: "", 13: "z" * 2001, 15: "p" * (K.PAYLOAD_CAP + 1)}
    rows = [(i, texts.get(i, f"short {i}")) for i in range(1, 22)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    turns = [(1, k, t) for k, t in enumerate(["12 Main St", "a (b) é!*\u0027 " * 60, "c" * 199, "c" * 200])]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{d}/conversations.parquet")
    return str(d)


def told(d, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in got.description]
    return sorted(({k: v for k, v in zip(names, r)} for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", ["container_roundtrip", "container_parts", "preserve_matrix", "action_address"])
def test_whole_texts_equal_sql(spark, long_texts, name):
    want = told(long_texts, name)
    df = catalog.queries()[name](spark, long_texts)
    assert sorted((r.asDict() for r in df.select(*want[0]).collect()), key=str) == want


def test_nothing_is_left_out(spark, long_texts):
    rows = {r["image_id"]: r for r in carriers.container_roundtrip(spark, long_texts).collect()}
    assert sorted(rows) == list(range(1, 22))
    assert [rows[i]["status"] for i in (4, 7, 8, 9)] == ["ok", K.TOO_LONG, "ok", "ok"]
    assert [i for i in rows if rows[i]["text"] is None] == [7, 11, 15]
    kept = carriers.preserve_matrix(spark, long_texts).collect()
    assert len(kept) == 63 and sum(r["text"] is not None for r in kept) == 63 - 3 * 3 - 2
    assert catalog.queries()["action_address"](spark, long_texts).count() == 4
