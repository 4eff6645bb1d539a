import itertools
import random

import pytest

import corpus_pipeline as C
from loomstone.llm import copies as K

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def test_stage_leaves_no_edited_copies(spark):
    """Of the stage in the pipeline: no two that stay are copies, and each that goes after SimHash is an earlier one's copy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grouped = {r["doc_id"]: plain_set(r["text"]) for r in C.near_duplicates(spark, docs, SF).collect()}
    kept = dict(C.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    stay = {r["doc_id"] for r in kept.collect()}
    assert stay < set(grouped)
    assert not [p for p in itertools.combinations(sorted(stay), 2) if similar(grouped[p[0]], grouped[p[1]])]
    for d in set(grouped) - stay:
        assert any(e < d and similar(grouped[e], s) for e, s in grouped.items())


@pytest.mark.parametrize("share", [20_000, 9])
def test_large_family_and_odd_rows(spark, odd_documents, no_documents, monkeypatch, share):
    monkeypatch.setattr(K, "SHARE", share)
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(w if rng.random() > 0.02 else "edited" + str(rng.random()) for w in base) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(base)), (500, "three short words"), (501, ""), (502, None)]
    rows = [(*r, 1, "n", "k") for r in rows]
    kept = {r["doc_id"] for r in K.without_copies(spark.createDataFrame(rows, "doc_id long, text string, row int, name string, key string")).collect()}
    sets = [plain_set(t) for t in texts]
    stay = sorted(k for k in kept if k is not None and k < 500)
    assert {500, 501, 502} <= kept and None not in kept and stay[0] == 0 and len(stay) < 120
    assert not [p for p in itertools.combinations(stay, 2) if similar(sets[p[0]], sets[p[1]])]
    assert K.without_copies(odd_documents.dropDuplicates(["text"])).columns == odd_documents.columns
    assert K.without_copies(no_documents).count() == 0


def test_shingles_of_parts(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(900)).encode()
    whole = K.shingles(text)
    assert len(whole) == len(plain_set(text.decode())) == 37
    monkeypatch.setattr(K, "word_parts", lambda t: iter([t.split()[:3], t.split()[3:500], t.split()[500:]]))
    assert (K.shingles(text) == whole).all()
