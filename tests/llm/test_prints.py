import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import prints as P


def fingerprint(text):
    x = P.prefix_hashes(P.code_points(text))
    return P.fingerprint_at(len(text), lambda at: x[:, at])


def plain_hash(points, base):
    """The sum of (c + 1) * base^i, modulo the prime, term by term."""
    total, power = 0, 1
    for c in points:
        total = (total + (ord(c) + 1) * power) % P.PRIME
        power = power * base % P.PRIME
    return total


def plain_fingerprint(text):
    """Samples of whole prefixes and suffixes, hashed one by one."""
    step = 1
    while len(text) // step > 32:
        step *= 2
    told = lambda spans: "".join(f"{plain_hash(s, r):08x}" for s in spans for r in P.BASES)
    places = range(step, len(text) + 1, step)
    return f"{len(text):x}.{told(text[:k] for k in places)}.{told(text[len(text) - k :] for k in places)}"


def plain_likeness(a, b):
    """Characters of the longer text in spans of the coarser grid that are equal in both, read off the texts."""
    if a == b:
        return 1.0
    step, longest = 1, max(len(a), len(b))
    while longest // step > 32:
        step *= 2
    marks = [bytearray(len(a)), bytearray(len(b))]
    for k in range(min(len(a), len(b)) // step):
        if a[k * step : (k + 1) * step] == b[k * step : (k + 1) * step]:
            for m in marks:
                m[k * step : (k + 1) * step] = b"1" * step
        if a[len(a) - (k + 1) * step : len(a) - k * step] == b[len(b) - (k + 1) * step : len(b) - k * step]:
            for m, t in zip(marks, (a, b)):
                m[len(t) - (k + 1) * step : len(t) - k * step] = b"1" * step
    return min(m.count(b"1") for m in marks) / longest if longest else 1.0


def ahead(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def want(rows):
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        near = (plain_likeness(text, edited), plain_likeness(text, following), ahead(text, edited), ahead(text, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(edited), *near))
    return out


def test_whole_table(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    assert sorted(map(tuple, P.op6_prints(spark, small).collect())) == sorted(want(rows))


def test_odd_rows(spark, odd_documents, no_documents):
    ordered = odd_documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    rows = [tuple(r) for r in ordered.collect()]
    for ranges in (1, 2, 5, 12):
        assert sorted(map(repr, map(tuple, P.document_prints(odd_documents, ranges).collect()))) == sorted(map(repr, want(rows)))
    assert P.document_prints(no_documents).count() == 0
    alone = P.document_prints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == want([(1, "abcdef")])


def test_spans_and_extensions():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab\U0001f9f5") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = (P.prefix_hashes(P.code_points(t)) for t in (a, b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert P.common_extension(x, i, y, j) == common
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert P.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        keep, take = rng.randint(0, len(a)), rng.randint(0, len(b))
        joined = P.prefix_hashes(P.code_points(a[:keep] + b[:take]))
        assert np.array_equal(P.joined_at(x, keep, y, take, np.arange(keep + take + 1)), joined)


def test_hot_ids(spark):
    """Ids, and nulls, that hold a third of all rows are spread over ranges, in the same order."""
    rng = random.Random(6)
    ids = [7] * 60 + [None] * 60 + [rng.randrange(40) for _ in range(60)] + [41] * 15
    docs = spark.createDataFrame([(d, f"text {rng.randrange(90)}", 0, 1) for d in ids], "doc_id long, text string, _range int, _tie int").repartition(3)
    ordered = docs.select("doc_id", "text").orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    expected = sorted(map(repr, want([tuple(r) for r in ordered.collect()])))
    for ranges in (3, 10, 40):
        found = P.document_prints(docs, ranges)
        assert sorted(map(repr, map(tuple, found.collect()))) == expected
        fullest = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert fullest < 60 or ranges < 10


def test_likeness():
    text = "the grey loom weaves at dawn " * 40
    near = lambda a, b: P.likeness(fingerprint(a), fingerprint(b))
    assert near(text, text) == 1 and near("", "") == 1 and near("", "a") == 0
    assert near(text, text[:500] + "X" + text[500:]) > 0.8
    assert near(text, "X" + text[1:-1] + "X") > 0.9  # a change at each end
    assert near(text, "something else " * 60) < 0.1
    assert fingerprint("ab") != fingerprint("ba") and fingerprint("a" * 100) != fingerprint("a" * 99 + "b")
    rng = random.Random(8)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 300)))
        b = "".join(c if rng.random() > 0.03 else "z" * rng.randint(0, 3) for c in a) if rng.random() < 0.8 else a[: rng.randint(0, len(a))]
        assert fingerprint(a) == plain_fingerprint(a) and near(a, b) == plain_likeness(a, b)
