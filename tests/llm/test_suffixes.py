import collections
import hashlib
import itertools
import random

import duckdb
import pytest

import corpus_pipeline

from loomstone.llm import suffixes as S


def brute(rows, length=400):
    counts = collections.Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] += 1
    out = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def found(frame):
    return sorted(repr(tuple(r)) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_cover():
    differences = {(a - b) % S.MODULUS for a in S.COVER for b in S.COVER}
    assert differences == set(range(S.MODULUS))


@pytest.mark.parametrize("block", [2 << 20, 2500])
def test_fixture(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    p, q, z = noise(330), noise(700), noise(2500)
    exact = "".join(rng.choice("wxyz") for _ in range(400))
    rows = [
        (1, None), (2, ""), (3, noise(300) + p + noise(200)), (4, noise(100) + p + noise(50)), (5, q), (5, q), (6, "x" + q),
        (None, noise(10) + q[:420] + noise(800) + q[5:500]), (7, z), (8, z[:1000] + "#" + z[1000:]), (9, "ab" * 1000),
        (10, "a" * 399), (11, "a" * 399), (12, noise(50) + exact), (13, exact + noise(40)), (14, "q" + exact[1:]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(S.dedup(docs)) == brute(rows)


def test_whole_table(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    assert found(S.op3_suffixes(spark, small)) == brute(rows)


def test_odd_rows_and_rewrite(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found(S.dedup(odd_documents)) == brute(rows)
    written = S.dedup(odd_documents, rewrite=True)
    assert written.columns[:7] == odd_documents.columns
    for r in written.collect():
        if r["text"] is None:
            assert r["n_bytes"] == 0
        else:
            assert len(r["text"]) == r["n_chars"]
            assert len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"]
    assert S.dedup(no_documents).count() == 0


def test_covers():
    for modulus, residues in S.COVERS.items():
        assert {(a - b) % modulus for a in residues for b in residues} == set(range(modulus))
    assert S.cover_for(400) == S.Cover() == (400, 273, 128) and S.cover_for(200) == (200, 133, 64)


def test_passage_of_51_words(spark):
    """The pipeline's stage cuts a passage of 51 words that stands in two texts; other lengths as by brute force."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = prose(51)
    assert 200 <= len(passage) < 400
    texts = [prose(90) + " " + passage + " " + prose(70), prose(33) + " " + passage + " " + prose(80), prose(300), passage[:199] + prose(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["repeated_spans"]
    after = {r["doc_id"]: r["text"] for r in stage(spark, frame, "").collect()}
    assert not any(passage in t for t in after.values()) and after[2] == texts[2] and after[3] == texts[3]
    for length in (70, 136, 199, 200, 233):
        counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        got = {r["doc_id"]: r["n_removed"] for r in S.dedup(frame, length=length).collect()}
        for d, t in enumerate(texts):
            gone = {j for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1 for j in range(i, i + length)}
            assert got[d] == len(gone)


def test_buckets(spark):
    """A task's block numbers are in the bucket that Spark's hash gives them."""
    for n in (1, 7, 200):
        numbers = [x for k in range(min(n, 5)) for x in itertools.islice(S.numbers_in(k, n), 20)]
        found = spark.createDataFrame([(x,) for x in numbers], "x long").selectExpr("x", f"pmod(hash(x), {n}) AS b").collect()
        assert [r["b"] for r in found] == [i // 20 for i in range(len(numbers))] and len(set(numbers)) == len(numbers)
