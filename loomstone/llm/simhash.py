"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits, and each segment has a table from its value to the
fingerprints that have it. Two fingerprints that differ in two bits or fewer differ in one bit or none
in one of the segments: so the Hamming ball of radius 1 is enumerated there, its values are fetched
from the segment's table, and every match is verified by its complete distance. Flips set bits only:
of two values one bit apart, the one with the 0 finds the other.

Segments this wide keep buckets small at any size but for texts made to meet in one. A bucket of
more than BUCKET members is taken out of its table, and all fingerprints that have its value or one
a bit away are linked another way: each is sent to the 65 values that are a bit or less away from the
whole of it, and those that meet at a value are two bits apart at most, so that links to the least of
them (verified, too) connect what has to be.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, attach_small, forget, fresh_path, gathered, join_spread, materialize, merged, rows_apart, rows_of, table

BITS, SEGMENTS, RADIUS, SEED, SHINGLE = 64, 2, 2, 42, 3
#: Members of a table's bucket that are compared one by one with what asks for it; links in a file.
BUCKET, LINKS = 256, 1_000_000
#: Nodes that a task folds into stars at a time.
RUN = 100_000
#: Texts are read in parts of about this many bytes, so that a very long one needs no more memory.
PART = 1 << 22
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def word_parts(text: bytes, size: int = PART) -> Iterator[list[bytes]]:
    """The words of a text, part by part; no word is cut."""
    start = 0
    while len(text) - start > size:
        part = text[start : start + size]
        keep = max(part.rfind(c, 1) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if keep < 0:  # one word longer than a part
            size *= 2
            continue
        yield part[:keep].split()
        start += keep
    yield text[start:].split()


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint: a bit is 1 if over half of the shingles' hashes have it; no words: 0."""
    digest, counts, total, held = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64), 0, []
    for part in word_parts((text or b"").lower()):
        words = held + part
        if len(words) < shingle:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        cells = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
        counts += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        total += len(hashes)
        held = words[len(words) - shingle + 1 :]
    if not total:
        return digest(b" ".join(held), seed) if held else 0
    bits = (2 * counts > total).reshape(BITS)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([simhash(row[1]) for row in rows_of(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every row."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


def segment_table(prints: DataFrame) -> DataFrame:
    """(key, fp): the distinct fingerprints of `prints` under each of their segments, whose number is in the key's upper half."""
    width = BITS // SEGMENTS
    keys = [F.shiftrightunsigned("fp", s * width).bitwiseAND((1 << width) - 1) + F.lit(s << width) for s in range(SEGMENTS)]
    return prints.select("fp").distinct().select(F.explode(F.array(*keys)).alias("key"), "fp")


def fetched(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of a segment table: each pair one bit or none apart in a segment, once for each such segment."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(BITS // SEGMENTS)])
    probes = members.select(F.col("fp").alias("a"), "key", F.explode(flips).alias("flip")).filter(F.col("key").bitwiseAND(F.col("flip")) == 0)
    probes = probes.select("a", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"))
    return members.join(merged(probes), "key").filter("not own or a < fp").select("a", F.col("fp").alias("b"))


def verified(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _around(prints: DataFrame, bits: range) -> DataFrame:
    """(fp, key): each fingerprint and what it becomes by a flip of one of `bits`, as keys."""
    flips = [0, *[1 << bit for bit in bits]]
    keys = F.array(*[F.col("fp").bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x).cast("long")) for x in flips])
    return prints.select("fp", F.explode(keys).alias("key"))


def crowded_links(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links that connect all pairs that meet in the `crowded` buckets of a segment table."""
    near = members.select("fp", F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(x).cast("long")) for x in [0, *(1 << b for b in range(BITS // SEGMENTS))]])).alias("key"))
    some = attach_small(near, crowded.withColumn("full", F.lit(True)), ["key"]).filter("full").select("fp").distinct()
    met = _around(some, range(BITS)).withColumn("least", F.min("fp").over(Window.partitionBy("key"))).filter("fp <> least")  # 65 rows a key at most
    return verified(met.select(F.col("fp").alias("a"), F.col("least").alias("b")))


def link_stars(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of `prints` that connect all pairs two bits apart or fewer."""
    members = segment_table(prints)
    crowded = materialize(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "crowded")
    if crowded.isEmpty():
        return verified(fetched(members)).distinct()
    calm = attach_small(members, crowded.withColumn("full", F.lit(True)), ["key"]).filter("full is null").select("key", "fp")
    return verified(fetched(calm)).unionAll(crowded_links(members, crowded)).distinct()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v), a run of them at a time: each node of a run that isn't the least it reaches in it, with that least one."""
    for above in _forests(batches):
        nodes = list(above)
        roots = [_top(above, node) for node in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, int]]:
    above: dict[int, int] = {}
    for batch in batches:
        for u, v in rows_of(batch):
            low, high = sorted((_top(above, u), _top(above, v)))
            if low != high:
                above[high] = low
            if len(above) >= RUN:
                yield above
                above = {}
    yield above


def _top(above: dict[int, int], node: int) -> int:
    while (parent := above.get(node, node)) != node:
        above[node] = node = above.get(parent, parent)
    return node


def components(links: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(node, root): the least node reachable from each node of the links (a, b) that isn't a root itself.

    Alternates large-star and small-star steps until nothing moves; before each pair of them the links are folded to
    stars within each task, so that few pairs are needed (one, where a task holds all links). Each step is written to
    the shared folder, for plans that the driver can hold, and the one before it is removed. Nodes of very many links
    are spread over tasks. `like` is a frame of about as many bytes as the links, at least.
    """
    spark = links.sparkSession
    path, steps = fresh_path(spark, "stars"), itertools.count()

    def written(df: DataFrame) -> DataFrame:
        step = next(steps)
        df.write.parquet(f"{path}/{step}")
        if step:
            forget(spark, f"{path}/{step - 1}")
        return spark.read.schema("u long, v long").parquet(f"{path}/{step}")

    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = written(links if like is None else gathered(links, like))
    mark = _mark(now)
    while mark[0]:
        now = written(now.coalesce(1 + 2 * mark[0] // LINKS).mapInArrow(_folded, "u long, v long"))
        mark = _mark(now)
        files = 1 + 2 * mark[0] // LINKS
        both = now.unionAll(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_spread(both, least, ["u"], "n", mark[0] <= HOT).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.coalesce(files))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, least, ["u"], "n", mark[0] <= HOT).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> Row:
    """The number of links (u, v), and what tells one set of them from another."""
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def rooted(prints: DataFrame) -> DataFrame:
    """Of distinct fingerprints: fp, n (rows that have it), first_id (the least doc_id among them) and root (the least fingerprint reachable)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = components(link_stars(prints), prints).withColumnRenamed("node", "fp")
    return materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots", like=prints)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row of `docs`.

    Null and empty texts have fingerprint zero and are linked like any other; the longest are read in
    parts; repeated rows each get their row; a null doc_id never names a component unless the
    component has no other. Further columns of `docs` are ignored, whatever their names. An empty
    table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "simhash")
    found = rooted(prints)
    named = found.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints"))
    by_print = join_spread(found.select("fp", "root", "n"), named, ["root"], "prints").select("fp", "component_id", "n")
    return join_spread(prints, by_print, ["fp"], "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each near-duplicate group, with all its columns, whatever their names.

    It is the one of least doc_id (a null one only if there is no other), then of least text hash; of
    rows equal in both the one whose columns hash least. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "simhash")
    groups = join_spread(prints, rooted(prints).select("fp", "root", "n"), ["fp"], "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    keep = groups.groupBy("root").agg(first, F.count("*").alias("n")).select(_key(F.col("first.doc_id")).alias("key"), F.col("first.text_hash").alias("hash"), "n")
    # two groups share no text, so that a key and a hash stand once here
    rows = rows_apart(docs, key=_key(F.col("doc_id")), hash=F.xxhash64(F.col("text").cast("string")))
    kept = join_spread(rows, keep, ["key", "hash"], "n")
    order = Window.partitionBy("key", "hash").orderBy(F.xxhash64("row"))  # each task sends the first of equal rows alone
    return kept.withColumn("turn", F.row_number().over(order)).filter("turn = 1").select("row.*")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit("none"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
