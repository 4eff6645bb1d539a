"""Edited copies: rows whose five-word shingles have a Jaccard similarity of 0.8 or more with an earlier row's.

MinHash signatures in bands find the candidates, whole shingle sets decide. Texts that agree in a
band share a key; keys that hold the same texts are one key; the texts of each key are read in
order, and one that is a copy of an earlier one that stayed under that key goes. The texts of a key of
very many are first read in shares, each in a task of its own, and what stays of all of them together after that.
No key is cut short, no set is sampled. Two texts at similarity s share a key but for a chance of (1 - s^6)^32:
0.00006 at 0.8, 0.0000002 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_garbage, give_back, join_spread, materialize, rows_apart, rows_of
from .simhash import word_parts

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Texts of a key that one task reads, as long as there is a point in reading them in shares.
SHARE = 20_000
#: Signatures that agree in under this share are not of similar sets (over five deviations from 0.8).
PLAUSIBLE = 0.62
_RNG = np.random.Generator(np.random.PCG64(20240517))
_ODD = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's runs of `size` lower-cased words, in order; of all words if they are fewer."""
    digest, found, held = xxhash.xxh64_intdigest, [], np.zeros(0, np.uint64)
    for part in word_parts((text or b"").lower()):
        words = np.concatenate([held, np.array([digest(w) for w in part], np.uint64)])
        if len(words) < size:
            held = words
            continue
        found.append(np.unique(_combined(words, size)))
        held = words[len(words) - size + 1 :]
    if not found:
        return _combined(held, len(held)) if len(held) else held
    return np.unique(np.concatenate(found))


def _combined(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += words[k : k + n] * _WEIGHTS[k]
        h ^= h >> np.uint64(29)
        h *= _A
    return h ^ (h >> np.uint64(32))


def signature(found: np.ndarray) -> np.ndarray:
    """For each of BANDS * ROWS orders of all hashes, the least of the set."""
    low, least = found.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 256):
        np.minimum(least, (low[start : start + 256, None] * _ODD + _ADD).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A name for the content and the number of each band."""
    h = (least.astype(np.uint64).reshape(BANDS, ROWS) * _MIX[:, :ROWS]).sum(1, dtype=np.uint64) + _MIX[:, ROWS]
    h ^= h >> np.uint64(31)
    h *= _A
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def packed(found: np.ndarray) -> np.ndarray:
    """A set's hashes in 32 bits, in order: half of what has to be sent."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(name, band_keys(signature(found)).tolist()) for name, text in rows_of(batch) if len(found := shingles(text))]
        names, keys = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["name", "keys"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            signs = [(signature(s) & np.uint32(0xFF)).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs, pa.binary()), pa.array([packed(s).tobytes() for s in sets], pa.binary())], ["doc_id", "name", "signs", "found"])


def _going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, name, signs, found), each part's in order: the names of copies of earlier ones that stay in it.

    Of two texts of a thousand words each two different shingles share 32 bits with a chance of 0.0005; their similarity is off by 0.001 then.
    """
    key, stay, signs, n = None, [], np.zeros((0, BANDS * ROWS), np.uint8), 0
    for batch in batches:
        gone = []
        for place, part, name, sign, found in rows_of(batch):
            if (place, part) != key:
                key, stay, signs, n = (place, part), [], np.zeros((4, BANDS * ROWS), np.uint8), 0
            sign, found = np.frombuffer(sign, np.uint8), np.frombuffer(found, np.uint32)
            likely = np.flatnonzero((signs[:n] == sign).mean(1) >= PLAUSIBLE) if n else ()
            if any(jaccard(stay[i], found) >= SIMILARITY for i in likely):
                gone.append(name)
                continue
            if n == len(signs):
                signs = np.concatenate([signs, np.zeros_like(signs)])
            signs[n] = sign
            stay.append(found)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["name"])
    stay.clear()
    give_back()


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (distinct texts) but for edited copies, with all their columns.

    No two rows that stay are copies of each other, and each row that goes has an earlier copy (the
    one of lesser doc_id, nulls last, then of lesser text hash), which stays or has an earlier one
    itself. Texts without words have no copies here. An empty table gives an empty result.
    """
    docs = materialize(docs, "copies-docs")
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("name"), text.cast("binary").alias("text"))
    banded = materialize(narrow.select("name", "text").mapInArrow(_banded, "name long, keys array<long>"), "copies-bands")
    rows = banded.select("name", F.explode("keys").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("name").alias("x"), F.bit_xor(F.xxhash64("name")).alias("y")).filter("n > 1")
    # keys of the same texts would ask the same again
    keys = materialize(held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "copies-keys", like=banded)
    members = materialize(join_spread(rows, keys.withColumn("rows", F.col("n")), ["key"], "rows"), "copies-members")
    drop_garbage(docs.sparkSession)
    chosen = narrow.join(members.select("name").distinct(), "name", "left_semi").select("doc_id", "name", "text")
    described = materialize(chosen.mapInArrow(_described, "doc_id long, name long, signs binary, found binary"), "copies-sets")
    gone = []
    if not keys.filter(F.col("n") > SHARE).isEmpty():
        gone.append(_gone(members.filter(F.col("n") > SHARE), described, SHARE))
        members = members.join(gone[0], "name", "left_anti")
    gone.append(_gone(members, described))
    every = gone[0] if len(gone) == 1 else gone[0].unionAll(gone[1]).distinct()
    drop_garbage(docs.sparkSession)
    rows = rows_apart(docs, name=F.xxhash64(text))
    return rows.join(every, "name", "left_anti").select("row.*")


def _gone(members: DataFrame, described: DataFrame, share: int | None = None) -> DataFrame:
    """Names of the copies among the members (key, name, n) of each key, or of each share of about `share` members of a key."""
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.lit(0).cast("long") if share is None else F.pmod(F.xxhash64("name", F.lit(1)), F.ceil(F.col("n") / share))
    asked = members.select("name", "key", part.alias("part")).join(described, "name").repartition(partitions, "key", "part")
    ordered = asked.sortWithinPartitions("key", "part", F.col("doc_id").asc_nulls_last(), "name")
    return materialize(ordered.select("key", "part", "name", "signs", "found").mapInArrow(_going, "name long").distinct(), "copies-gone", like=members)
