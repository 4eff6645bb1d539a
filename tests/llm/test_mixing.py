import os

import duckdb
import pytest

from loomstone.llm.mixing import OP5_SQL, mix, mix_sql, mixed_rows, op5_mix


def rows_of(frame):
    return sorted(tuple(map(repr, r)) for r in frame)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(OP5_SQL).fetchall()
    got = op5_mix(spark, path).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert rows_of(map(tuple, got)) == rows_of(want)


def test_odd_rows(odd_documents):
    docs = odd_documents.toPandas().astype(object)
    docs = docs.where(docs.notna(), None)
    con = duckdb.connect()
    con.register("frame", docs[["doc_id", "text", "source"]])
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    want = con.execute(f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, taken FROM m").fetchall()
    got = mix(odd_documents)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "size", "source_size", "target", "taken"]
    got = got.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert rows_of(map(tuple, got)) == rows_of(want)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert rows_of(map(tuple, mix(odd_documents, narrow=True).collect())) == rows_of(map(tuple, got))


def test_mixed_rows(odd_documents):
    taken = {}
    for r in mix(odd_documents).collect():
        taken[r["doc_id"], r["text"]] = taken.get((r["doc_id"], r["text"]), 0) + (r["taken"] // r["size"] if r["size"] else 0)
    found = {}
    for r in mixed_rows(odd_documents).collect():
        found[r["doc_id"], r["text"]] = found.get((r["doc_id"], r["text"]), 0) + 1
    assert found == {k: n for k, n in taken.items() if n}


def test_empty(no_documents):
    assert mix(no_documents).count() == 0
    assert mixed_rows(no_documents).count() == 0


def test_clashing_columns(spark):
    """Columns named like those made inside, or like the added ones, stay in the mixed rows."""
    names = ["size", "source_size", "target", "taken", "repeats", "threshold", "_k", "_h", "row", "copy", "id"]
    docs = spark.createDataFrame([(i, "some words here " * (i % 4), "s" if i % 2 else None, *range(11)) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    found = mixed_rows(docs)
    assert found.columns == docs.columns and all(tuple(r)[3:] == tuple(range(11)) for r in found.collect())
    assert mix(docs).columns == ["doc_id", "text", "source", *names[4:], *names[:4]]
    assert mix(docs, narrow=True).columns == ["doc_id", *names[:4]]
