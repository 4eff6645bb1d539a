import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomstone.llm import packing as P


def whole_ids(texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(encoder.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def check(rows, pieces):
    want = {}
    for (doc_id, _), ids in zip(rows, whole_ids([t for _, t in rows])):
        want.setdefault(repr(doc_id), []).append(ids)
    windows = {}
    left = {k: sum(map(len, v)) for k, v in want.items()}
    for p in pieces:
        key = repr(p["doc_id"])
        match = [ids for ids in want[key] if len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert match and p["length"] > 0
        left[key] -= p["length"]
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert not any(left.values())
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.WINDOW
    return len(windows)


def test_whole_table(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    pieces = P.op9_packing(spark, small).collect()
    windows = check(rows, pieces)
    assert sum(p["length"] for p in pieces) > 0.97 * P.WINDOW * (windows - 1)


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    check(rows, P.pack(odd_documents, shard=3).collect())
    with_ids = P.pack(odd_documents, with_ids=True).collect()
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in with_ids)
    assert P.pack(no_documents).count() == 0


def test_split_encoding(monkeypatch):
    monkeypatch.setattr(P, "PART", 50)
    monkeypatch.setattr(P, "REMEMBERED", 20)
    text = "It's  a loom’s\tthread, DON'T\nstop: 12'345 <|endoftext|> Éá " * 9 + "x" * 200
    assert np.array_equal(np.frombuffer(P.WordIds().encode(text), "<u4"), whole_ids([text])[0][:-1])


def test_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        lengths = np.array([rng.randint(1, 40) for _ in range(rng.randint(0, 120))], np.int64)
        sequence, offset = P.best_fit_decreasing(lengths, 40)
        open_, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the plain form
            fits = [room for room in open_ if room >= lengths[i]]
            room = min(fits) if fits else 40
            if fits:
                open_.remove(room)
            if room > lengths[i]:
                open_.append(room - lengths[i])
            want[i] = 40 - room
        assert [want[i] for i in range(len(lengths))] == offset.tolist()
