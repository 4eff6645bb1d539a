"""Packing documents into fixed windows by best-fit decreasing.

Documents are tokenised, closed by an end id, and cut into full windows first. What is left of them
goes, longest first, into the open window with the least room that still fits; a segment tree over
remaining capacities finds that window. Shards of bounded size are packed independently.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, table, worker_cache

WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Pieces that one task packs; runs in a generation of those whose ids a worker knows (some 60 MB); characters split at a time, and learned from.
SHARD, REMEMBERED, PART, GROUP = 50_000, 350_000, 1 << 20, 1 << 18


class WordIds:
    """Ids of texts for a tokenizer that drops white space: runs between blanks are encoded when they are new.

    For a byte-pair tokenizer that lower-cases, splits by one pattern and marks the ends of words, runs
    are split by that pattern here, and only pieces not seen before are encoded, many in one call:
    the marked ids tell where each ends. Lower-casing is left to the tokenizer where the two might
    differ (texts not in composed form, and letters whose lower case depends on their place or
    takes two characters), and so are pieces of anything but letters or ASCII, and all texts that hold
    one of the tokenizer's special strings.

    What is known is kept in two generations: when the younger is full it becomes the older, and what
    the older knows moves to the younger on use, so that runs met once are forgotten and others stay.
    """

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        if "/" not in tokenizer:
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self._encoder = Tokenizer.from_file(tokenizer)
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        spec = json.loads(self._encoder.to_str())
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self._split = None
        if lowers and [x["type"] for x in steps] == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>":
            self._split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self._plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
            self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = spec["model"]["vocab"]
            self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PART:
            cut = text.rfind(" ", start + 1, start + PART)
            if cut < 0 and (cut := text.find(" ", start + PART)) < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Pieces that the pattern leaves whole, of letters or printable ASCII."""
        ids = np.array(self._plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self._closes[ids]) + 1) * 4).tolist()
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer does not mark the end of every piece")
        blob, start, known = ids.tobytes(), 0, self._known
        for piece, end in zip(pieces, ends):
            known[piece] = blob[start:end]
            start = end

    def _learn(self, runs: list[str], lowered: bool) -> None:
        known, rest = self._known, runs
        if lowered and self._split:
            new, split, rest = {}, {}, []
            for run in runs:
                if run.isalpha():  # one piece
                    new[run] = None
                    continue
                pieces = self._split(run)
                if run.isascii() and run.isprintable() or all(p.isalpha() or p.isascii() and p.isprintable() for p in pieces):
                    split[run] = pieces
                else:
                    rest.append(run)
            new.update(dict.fromkeys(p for pieces in split.values() for p in pieces if p not in known))
            if new:
                self._learn_pieces(list(new))
            for run, pieces in split.items():
                known[run] = b"".join([known[p] for p in pieces])
        if rest:
            for run, found in zip(rest, self._encoder.encode_batch_fast(rest, add_special_tokens=False)):
                known[run] = np.array(found.ids, "<u4").tobytes()

    def _ids_of(self, lists: list[tuple[list[str], bool]]) -> list[bytes]:
        """The ids of lists of runs; what is new in any of them is learned at once."""
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {"": b""}
        known, older = self._known, self._older
        found, missing = [], ({}, {})
        for runs, lowered in lists:
            got = list(map(known.get, runs))
            places = [i for i, ids in enumerate(got) if ids is None] if None in got else []
            left = []
            for i in places:
                run = runs[i]
                if (ids := older.pop(run, None)) is not None:
                    got[i] = known[run] = ids
                else:
                    missing[lowered][run] = None
                    left.append(i)
            found.append((got, left))
        for lowered in (True, False):
            if new := [run for run in missing[lowered] if run not in known]:
                self._learn(new, lowered)
        for (runs, _), (got, left) in zip(lists, found):
            for i in left:
                got[i] = known[runs[i]]
        return [b"".join(got) for got, _ in found]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, as the tokenizer gives them for it as a whole."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[list[str], bool]] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(special in text for special in self._special):
                out[k].append(np.array(self._encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            for part in self._parts(text):
                lowered = part.isascii() or not ("\u03a3" in part or "\u0130" in part) and unicodedata.is_normalized("NFC", part)
                if lowered and self._split:
                    part = part.lower()
                held.append((part.replace("\n", " ").split(" "), lowered))
                owners.append(k)
                size += len(part)
                if size >= GROUP:
                    for owner, ids in zip(owners, self._ids_of(held)):
                        out[owner].append(ids)
                    held, owners, size = [], [], 0
        if held:
            for owner, ids in zip(owners, self._ids_of(held)):
                out[owner].append(ids)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def cut_pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece, with the ids themselves if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept, end = worker_cache(), np.array([end_id], "<u4").tobytes()
        encoder = kept.get(("word-ids", tokenizer))
        if encoder is None:
            encoder = kept["word-ids", tokenizer] = WordIds(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            ids: list[bytes] = []
            parts = (batch.slice(start, 1000) for start in range(0, batch.num_rows, 1000))
            found = (pair for part in parts for pair in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1).to_pylist())))
            for doc_id, own_ids in found:
                all_ids = own_ids + end
                n = len(all_ids) // 4
                for start in range(0, n, window):
                    piece = all_ids[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
                    if with_ids:
                        ids.append(piece)
            arrays = [pa.array(r, pa.int64()) for r in rows]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return narrow.mapInArrow(cut, schema)


class Capacities:
    """A segment tree over remaining capacities 0 … window that says which ones have an open window."""

    def __init__(self, window: int) -> None:
        self._base = 1 << window.bit_length()
        self._any = [False] * (2 * self._base)
        self._open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int, value: bool) -> None:
        node, tree = self._base + capacity, self._any
        tree[node] = value
        while node > 1:
            node >>= 1
            now = tree[2 * node] or tree[2 * node + 1]
            if tree[node] == now:
                return
            tree[node] = now

    def put(self, capacity: int, sequence: int) -> None:
        if not self._open[capacity]:
            self._mark(capacity, True)
        self._open[capacity].append(sequence)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for `need`: its capacity and number."""
        tree, node = self._any, self._base + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._base:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self._base
        sequence = self._open[capacity].pop()
        if not self._open[capacity]:
            self._mark(capacity, False)
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, longest first (ties in the order given)."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, opened = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = room.take(need) if need < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, number = found
        sequence[i], offset[i] = number, window - capacity
        if capacity > need:
            room.put(capacity - need, number)
    return sequence, offset


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Every piece of every row of `docs` with its sequence_id and its offset there.

    Null and empty texts are the end id alone; very long ones give as many full windows as they
    fill; rows that repeat are packed like any others; further columns are ignored; an empty table
    gives an empty result. With `with_ids` the ids (binary, unsigned 32-bit, little-endian) come too.
    """
    pieces = materialize(cut_pieces(docs, window, tokenizer, end_id, with_ids), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    schema = pieces.drop("ids").schema.simpleString()[len("struct<") : -1] + ",sequence_id:long,offset:long"
    order = ["length", "doc_id", "start", "ids_crc32", "_row"]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns=["_shard"]).assign(sequence_id=sequence + (int(key[0]) << 40), offset=offset)

    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.drop("ids").withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    placed = dealt.groupBy("_shard").applyInPandas(place, schema.replace(":", " ") + ", _row long")
    if with_ids:
        placed = placed.join(numbered.select("_row", "ids"), "_row")
    return placed.drop("_row")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
