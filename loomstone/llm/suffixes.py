"""Suffix-array dedup with a distributed difference cover.

The suffixes at positions whose residue modulo 273 lies in a perfect difference cover are the sample.
For any two positions some shift below 273 puts both into the sample, so of two equal 400-byte strings
a sampled pair starts within both with 128 equal bytes. The steps:

1. Sampled suffixes are named by their first 128 bytes; the names are sorted, range by range, and
   neighbours that are equal mark the names found twice. All other names are discarded.
2. The same again, one level deeper, for sampled suffixes whose name was kept: of the 273 strings that
   hold such a head, those that start within the same 32 bytes have 369 bytes in common, which get
   a name; again only names found twice are kept.
3. The remaining suffixes are those that a kept name still admits. Sampled or not, they are merged by the
   name of their 400-byte prefix, sorted range by range, and adjacent prefixes are compared: equal ones
   are the repeats. Prefixes are bounded by 400 bytes, so that there is no further level.
4. Every position of a repeat covers the 400 bytes from it on.

Only equality is asked of adjacent prefixes, never the order of distinct ones, so a name is a hash and
not a rank: 64 bits in steps 1 and 2, which only sort out, and 128 bits in step 3 and of whole texts, which
decide. Of 10^14 prefixes two different ones share a name with a chance of 10^-11. A block of documents
sends each of its names once (a hot passage costs one name a block, however many of its documents hold
it) and gets one bit back for each. Texts themselves are written once, in blocks bucketed by number, and
never shuffled. The figures above are op3's; for strings of another length the cover and the heads follow
from it (cover_for).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_garbage, fresh_path, give_back, materialize, rows_of, table

LENGTH = 400
#: A perfect difference cover: every residue but 0 is the difference of exactly one pair (fixed values).
MODULUS = 273
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
HEAD = LENGTH - MODULUS + 1
#: Perfect difference covers for shorter strings, by modulus.
COVERS = {
    MODULUS: COVER,
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
    7: (1, 2, 4),
}
LEAST_HEAD = 64
#: Starts of strings around a sampled suffix that share a name in step 2.
STARTS = 32
#: Bytes of text in a block (a longer document is a block of its own), of names in a range, and of text for each task.
BLOCK, RANGE, TASK = 1 << 20, 32 << 20, 32 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIERS = _RNG.integers(1, 1 << 63, HEAD // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(int(x)) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Odd multipliers of the two halves of a prefix's name.
_HALVES = ((_A, _B, _C), tuple(_RNG.integers(1, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))


class Cover(NamedTuple):
    """The length of the strings that count as repeats, and which suffixes are sampled for it."""

    length: int = LENGTH
    modulus: int = MODULUS
    head: int = HEAD


def cover_for(length: int) -> Cover:
    """The sparsest cover whose sampled suffixes still have LEAST_HEAD bytes within a string of `length`."""
    for modulus in COVERS:
        head = (length - modulus + 1) // 8 * 8
        if head >= LEAST_HEAD:
            return Cover(length, modulus, min(head, HEAD))
    raise ValueError(f"strings of {length} bytes are too short: {min(COVERS) + LEAST_HEAD - 1} at least")


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= _B
    h ^= h >> np.uint64(27)
    h *= _C
    h ^= h >> np.uint64(31)
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """The unaligned 8-byte word at every position (data is padded by 8 bytes or more)."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))


def head_names(data: np.ndarray, n: int, cover: Cover = Cover()) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions below n - head + 1, by residue, and the names of the head's bytes at each."""
    words, places, names = _eights(data), [], []
    for residue in COVERS[cover.modulus]:
        at = np.arange(residue, n - cover.head + 1, cover.modulus)
        if not len(at):
            continue
        h = np.zeros(len(at), np.uint64)
        stop = int(at[-1]) + 1
        for k in range(cover.head // 8):
            w = words[residue + 8 * k : stop + 8 * k : cover.modulus]
            h += (w ^ (w >> np.uint64(32))) * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        places.append(at)
        names.append(_finish(h))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(names)


def span_names(data: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Names of the `size` bytes (8 or more) from each of `begin` on."""
    words, h = _eights(data), np.full(len(begin), size, np.uint64)
    for k in [*range(0, size - 7, 8), size - 8]:
        h = (h ^ words[begin + k]) * _FOLD[0]
        h ^= h >> np.uint64(32)
        h *= _FOLD[1]
    return _finish(h)


def prefix_names(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Names, of two halves, of the `length` bytes at every position of `data` that has as many (by doubling)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = _eights(padded)[: len(data) - 7]
    out = np.empty((len(data) - length + 1, 2), np.uint64)
    for half, (a, b, c) in enumerate(_HALVES):
        h, size = (eights ^ (eights >> np.uint64(29 + half))) * a, 8
        while size <= length // 2:
            h = _doubled(h, size, b, c)
            size *= 2
        if size < length:
            h = _doubled(h, length - size, b, c)
        out[:, half] = _finish(h)
    return out


def _doubled(h: np.ndarray, step: int, b: np.uint64, c: np.uint64) -> np.ndarray:
    tail = h[step:]
    tail = (tail ^ (tail >> np.uint64(31))) * b
    tail += h[: len(h) - step]
    tail ^= tail >> np.uint64(29)
    tail *= c
    return tail


def in_order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of names (n, or n by 2 halves), and which of them in that order equal the one before."""
    first = names if names.ndim == 1 else names[:, 0]
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    if names.ndim == 2 and same.any():
        if (names[order[1:], 1] != names[order[:-1], 1])[same].any():
            order = np.lexsort((names[:, 1], first))
        same = (names[order[1:]] == names[order[:-1]]).all(axis=1)
    return order, np.concatenate([np.zeros(min(1, len(names)), bool), same])


class Names:
    """The distinct names of a block in order, cut into ranges of the name space."""

    def __init__(self, names: np.ndarray, ranges: int) -> None:
        self.order, again = in_order(names)
        self._index = np.cumsum(~again) - 1
        self.distinct = names[self.order[~again]]
        self._twice = np.bincount(self._index, minlength=len(self.distinct)) > 1
        first = self.distinct if names.ndim == 1 else self.distinct[:, 0]
        place = ((first >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.cuts = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))

    def sent(self) -> Iterator[tuple[int, bytes]]:
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield k, self.distinct[self.cuts[k] : self.cuts[k + 1]].tobytes()

    def repeated(self, replies: list[dict]) -> np.ndarray:
        """For each name given, in the order given, whether it was found twice, here or elsewhere."""
        found = self._twice.copy()
        for reply in replies:
            a, b = self.cuts[reply["range"]], self.cuts[reply["range"] + 1]
            found[a:b] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=b - a).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = found[self._index]
        return out


class Block:
    """Documents side by side: the bytes of their texts and where each begins."""

    def __init__(self, payload: bytes, column: str, cover: Cover = Cover()) -> None:
        self.cover = cover
        self.rows = pa.ipc.open_stream(pa.py_buffer(payload)).read_all().combine_chunks()
        texts = self.rows.column(column)
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
        texts = texts.cast(pa.large_string()).fill_null("")
        if len(texts):
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            self.edges = offsets - offsets[0]
        else:
            data, self.edges = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.n = len(data)
        self.data = np.concatenate([data, np.zeros(cover.length + 16, np.uint8)])
        self.lengths = np.diff(self.edges)

    def starts(self, size: int, docs: np.ndarray | None = None) -> np.ndarray:
        """A mask of the positions from which `size` bytes lie within one document (of `docs`)."""
        change = np.zeros(self.n + 1, np.int32)
        fit = self.lengths >= size
        if docs is not None:
            fit &= docs
        np.add.at(change, self.edges[:-1][fit], 1)
        np.add.at(change, self.edges[1:][fit] - size + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a string's length or more, and a name for the whole text of each."""
        long = np.flatnonzero(self.lengths >= self.cover.length)
        view = memoryview(self.data)
        names = [hashlib.blake2b(view[self.edges[i] : self.edges[i + 1]], digest_size=16).digest() for i in long.tolist()]
        return long, np.frombuffer(b"".join(names), "<u8").astype(np.uint64).reshape(-1, 2)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        places, names = head_names(self.data, self.n, self.cover)
        inside = self.starts(self.cover.head)[places] if self.n else np.zeros(0, bool)
        return places[inside], names[inside]

    def longer(self, heads: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of `heads` and each STARTS starts of strings around it: the first and last of these starts, and the name of what the strings share."""
        length, modulus, first, last, names = self.cover.length, self.cover.modulus, [], [], []
        of = np.searchsorted(self.edges, heads, side="right") - 1
        heads, of = heads[docs[of]], of[docs[of]]
        least, most = self.edges[of], self.edges[of + 1]
        for low in range(0, modulus, STARTS):
            high = min(low + STARTS, modulus) - 1  # the strings start between `high` and `low` bytes before the head
            size = length - high + low
            begin = (heads - low)[(heads - low >= least) & (heads - low + size <= most)]
            first.append(begin + low - high)
            last.append(begin)
            names.append(span_names(self.data, begin, size))
        return np.concatenate(first), np.concatenate(last), np.concatenate(names)

    def remaining(self, first: np.ndarray, last: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the chosen documents between a `first` and its `last`, and their prefixes' names."""
        length = self.cover.length
        change = np.zeros(self.n + 1, np.int32)
        np.add.at(change, np.maximum(first, 0), 1)
        np.add.at(change, last + 1, -1)
        places = np.flatnonzero((np.cumsum(change[:-1]) > 0) & self.starts(length, docs))
        if not len(places):
            return places, np.zeros((0, 2), np.uint64)
        gaps = np.flatnonzero(np.diff(places) > length) + 1  # runs further apart than a prefix are named apart
        names = [prefix_names(self.data[run[0] : run[-1] + length], length)[run - run[0]] for run in np.split(places, gaps)]
        return places, np.concatenate(names)

    def covered(self, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A mask of the bytes within a string's length of a start, or in a document that goes whole."""
        change = np.zeros(self.n + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.cover.length, -1)
        np.add.at(change, self.edges[:-1][whole], 1)
        np.add.at(change, self.edges[1:][whole], -1)
        return np.cumsum(change[:-1]) > 0


def buckets_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets that Spark puts these longs (0 or more) in: its Murmur3 hash, seed 42, modulo their count."""
    u = lambda x: x & np.uint64(0xFFFFFFFF)
    turn = lambda x, r: u(x << np.uint64(r)) | (x >> np.uint64(32 - r))
    h = np.full(len(numbers), 42, np.uint64)
    for half in (u(numbers), numbers >> np.uint64(32)):
        h = u(turn(h ^ u(turn(u(half * np.uint64(0xCC9E2D51)), 15) * np.uint64(0x1B873593)), 13) * np.uint64(5) + np.uint64(0xE6546B64))
    h ^= np.uint64(8)
    h = u((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B))
    h = u((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35))
    h ^= h >> np.uint64(16)
    return h.astype(np.uint32).view(np.int32).astype(np.int64) % buckets


def numbers_in(bucket: int, buckets: int) -> Iterator[int]:
    """Random numbers that Spark puts in one bucket."""
    while True:
        drawn = np.frombuffer(os.urandom(32 * buckets), np.uint64) >> np.uint64(1)
        yield from drawn[buckets_of(drawn, buckets) == bucket].tolist()


def _blocks(docs: DataFrame, column: str, buckets: int) -> DataFrame:
    """(block, n_bytes, payload): the rows of `docs` as compressed Arrow streams of about BLOCK bytes of text.

    The blocks of a task have numbers of one bucket, so that each task writes one file.
    """
    at = docs.columns.index(column)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        numbers = numbers_in(TaskContext.get().partitionId() % buckets, buckets)

        def told(rows: pa.Table, size: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_table(rows.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_bytes", "payload"])

        held, size = [], 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
            start = 0
            for i, length in enumerate(lengths):
                size += length
                if size >= BLOCK or i - start >= 50_000:
                    held.append(batch.slice(start, i + 1 - start))
                    yield told(pa.Table.from_batches(held), size)
                    held, size, start = [], 0, i + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield told(pa.Table.from_batches(held), size)
        held.clear()
        give_back()

    return docs.mapInArrow(packed, "block long, n_bytes long, payload binary")


#: Kinds of names: whole texts, heads of sampled suffixes, what strings around them share, prefixes of remaining suffixes.
WHOLE, HEADS, LONGER, PREFIXES = range(4)
#: Halves (of 64 bits) of a name of each kind.
WIDTH = (2, 1, 1, 2)
_SENT = "kind int, range int, block long, names binary"
_REPLY = "block long, kind int, range int, bits binary"


def _send(block: int, kind: int, names: Names) -> pa.RecordBatch | None:
    rows = list(names.sent())
    if not rows:
        return None
    ranges, blobs = zip(*rows)
    arrays = [pa.array([kind] * len(rows), pa.int32()), pa.array(ranges, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "range", "block", "names"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by kind, range, block: sort each range's names, compare neighbours, answer each block.

    A whole text's block is told with a second half of bits whether it holds the first copy.
    """
    held: list[tuple[int, bytes]] = []
    key = None

    def answered(key: tuple[int, int], held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        width = WIDTH[key[0]]
        names = np.concatenate([np.frombuffer(b, "<u8") for _, b in held])
        names = names if width == 1 else names.reshape(-1, width)
        order, again = in_order(names)
        twice, first = np.zeros(len(names), bool), np.ones(len(names), bool)
        twice[order[again]] = True
        twice[order[:-1][again[1:]]] = True
        first[order[again]] = False
        rows, at = [], 0
        for block, blob in held:
            n = len(blob) // (8 * width)
            if twice[at : at + n].any():
                bits = np.packbits(twice[at : at + n]).tobytes()
                if key[0] == WHOLE:
                    bits += np.packbits(first[at : at + n]).tobytes()
                rows.append((block, key[0], key[1], bits))
            at += n
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "kind", "range", "bits"])

    for batch in batches:
        for kind, place, block, names in rows_of(batch):
            if key != (kind, place):
                if held:
                    yield answered(key, held)
                key, held = (kind, place), []
            held.append((block, names))
    if held:
        yield answered(key, held)


def _copies(block: Block, replies: list[dict], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: whether its whole text stands elsewhere too, and whether it is left out below.

    Of copies the first one alone goes on, as what other documents are held against.
    """
    long, names = block.digests()
    found = Names(names, ranges)
    halves = []
    for r in replies:
        half = len(r["bits"]) // 2
        halves.append((r["range"], r["bits"][:half], r["bits"][half:]))
    copied = found.repeated([{"range": k, "bits": a} for k, a, _ in halves])
    first = np.ones(len(found.distinct), bool)
    for k, _, b in halves:
        low, high = found.cuts[k], found.cuts[k + 1]
        first[low:high] = np.unpackbits(np.frombuffer(b, np.uint8), count=high - low).astype(bool)
    leads = np.zeros(len(names), bool)  # the first row of each distinct text of this block
    leads[found.order[np.flatnonzero(np.diff(found._index, prepend=-1))]] = True
    goes = np.zeros(len(names), bool)
    goes[found.order] = first[found._index]
    repeated, out = np.zeros(len(block.lengths), bool), np.zeros(len(block.lengths), bool)
    repeated[long] = copied
    out[long] = copied & ~(goes & leads)
    return repeated, out


def _of_kind(replies: list[dict] | None, kind: int) -> list[dict]:
    return [r for r in replies or [] if r["kind"] == kind]


def _ask(sent: DataFrame, partitions: int, label: str) -> DataFrame:
    """Compare names range by range; the replies are written, so that later steps don't ask again."""
    dealt = sent.repartition(partitions, "kind", "range").sortWithinPartitions("kind", "range", "block")
    return materialize(dealt.mapInArrow(_compare, _REPLY), label)


def _with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    every = replies[0]
    for more in replies[1:]:
        every = every.unionAll(more)
    gathered = every.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "bits")).alias("replies"))
    return blocks.join(gathered, "block", "left").select("block", "payload", "replies")


def dedup(docs: DataFrame, text: str = "text", rewrite: bool = False, without_text: bool = False, length: int = LENGTH, counts: bool = True) -> DataFrame:
    """Every row of `docs` with n_bytes, n_removed, n_spans and kept_sha256 of its whole text.

    Removed is each byte of a string of `length` bytes that also starts elsewhere, in the same or another
    document; strings are judged on the input. Null texts are empty (0 bytes, the empty digest);
    texts below `length` keep everything; repeated rows lose everything from `length` on, for each
    stands elsewhere too; an empty table gives an empty result; columns named like the added ones
    are replaced. A document of any length is a block of its own, of some 30 bytes of memory for each byte.
    With `rewrite` the text column holds what is kept (a character cut by a boundary is
    dropped; null stays null) and n_chars, where there is one, its length. `without_text` leaves the
    text column out of the result; without `counts` nothing is added and all columns stay.
    """
    spark, cover = docs.sparkSession, cover_for(length)
    if counts:
        docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    name, path = f"loomstone_blocks_{uuid.uuid4().hex}", fresh_path(spark, "blocks")
    _blocks(docs, text, partitions).write.bucketBy(partitions, "block").option("path", path).option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name alone: the files are read on
    drop_garbage(spark)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = int(max(2 * partitions, -(-8 * total // RANGE)))

    def send_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in rows_of(batch, 1):
                block = Block(payload, text, cover)
                for kind, names in ((WHOLE, block.digests()[1]), (HEADS, block.heads()[1])):
                    if (rows := _send(number, kind, Names(names, ranges))) is not None:
                        yield rows

    heads = _ask(blocks.select("block", "payload").mapInArrow(send_heads, _SENT), partitions, "heads")
    drop_garbage(spark)

    class Resumed:
        """A block as far as the replies go."""

        def __init__(self, payload: bytes, replies: list[dict] | None) -> None:
            self.block = Block(payload, text, cover)
            self.repeated, out = _copies(self.block, _of_kind(replies, WHOLE), ranges)
            self.replies, self.docs = replies, ~out
            places, names = self.block.heads()
            hits = places[Names(names, ranges).repeated(_of_kind(replies, HEADS))]
            self.first, self.last, names = self.block.longer(hits, self.docs)
            self.longer = Names(names, ranges)

        def prefixes(self) -> tuple[np.ndarray, Names]:
            kept = self.longer.repeated(_of_kind(self.replies, LONGER))
            starts, names = self.block.remaining(self.first[kept], self.last[kept], self.docs)
            return starts, Names(names, ranges)

    def send_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, replies in rows_of(batch, 1):
                if (rows := _send(number, LONGER, Resumed(payload, replies).longer)) is not None:
                    yield rows

    def send_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, replies in rows_of(batch, 1):
                if (rows := _send(number, PREFIXES, Resumed(payload, replies).prefixes()[1])) is not None:
                    yield rows

    longer = _ask(_with_replies(blocks, heads).mapInArrow(send_longer, _SENT), partitions, "longer")
    drop_garbage(spark)
    prefixes = _ask(_with_replies(blocks, heads, longer).mapInArrow(send_prefixes, _SENT), partitions, "prefixes")
    drop_garbage(spark)

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*(f for f in docs.schema.fields if not (without_text and f.name == text)), *(added if counts else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, payload, replies in rows_of(batch, 1):
                resumed = Resumed(payload, replies)
                block = resumed.block
                starts, names = resumed.prefixes()
                gone = block.covered(starts[names.repeated(_of_kind(replies, PREFIXES))], resumed.repeated)
                removed, spans, digests, kept = [], [], [], []
                for a, b in zip(block.edges[:-1].tolist(), block.edges[1:].tolist()):
                    mask = gone[a:b]
                    n = int(mask.sum())
                    rest = block.data[a:b] if not n else block.data[a:b][~mask]
                    removed.append(n)
                    spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if n else 0)
                    rest = rest.tobytes()
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if rewrite:
                        kept.append(rest.decode("utf-8", "ignore"))
                rows = block.rows
                if rewrite:
                    present = rows.column(text).is_valid().to_pylist()
                    texts = pa.array([t if p else None for t, p in zip(kept, present)], rows.schema.field(text).type)
                    rows = rows.set_column(rows.column_names.index(text), rows.schema.field(text), texts)
                    if "n_chars" in rows.column_names:
                        sizes = pa.array([len(t) if p else c for t, p, c in zip(kept, present, rows.column("n_chars").to_pylist())], rows.schema.field("n_chars").type)
                        rows = rows.set_column(rows.column_names.index("n_chars"), rows.schema.field("n_chars"), sizes)
                for column, values, kind in () if not counts else (("n_bytes", block.lengths, pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64()), ("kept_sha256", digests, pa.string())):
                    rows = rows.append_column(column, pa.array(values, kind))
                yield from (rows.drop_columns([text]) if without_text else rows).combine_chunks().to_batches()

    return _with_replies(blocks, heads, longer, prefixes).mapInArrow(finish, schema)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), without_text=True)
