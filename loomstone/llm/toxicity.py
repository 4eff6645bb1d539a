"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed into a fixed table of vectors); a window of
neighbouring words averages their vectors into a two-class softmax, and a text is as toxic as its
worst window. Misspellings and inflections that training never saw share most of their n-grams with
words that it did see. Once trained, the softmax is linear in each n-gram's vector, so every n-gram
collapses to one number and every word to the mean of its n-grams' numbers.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, give_back, materialize, rows_of, table

#: Training reads at most this many labelled rows, those of least hash, and their whole texts.
SAMPLE_ROWS = 5_000
BUCKETS, DIM, WINDOW, GRAMS = 1 << 15, 8, 2, (3, 4, 5, 6)
THRESHOLD = 0.3
#: Words whose scores a worker remembers; characters of a text scored at a time.
REMEMBERED, PART = 400_000, 1 << 20
#: Words whose n-grams training looks at together.
SLICE = 20_000
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _class(low: int, high: int) -> re.Pattern:
    """White space, punctuation, symbols and the zero-width space in a range of code points."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(low, high)) if c.isspace() or c == "\u200b" or unicodedata.category(c)[0] in "ZPS") + "]")


#: Those beyond ASCII, plane by plane (no others have any): re looks them up in the first one and goes through a list in the second.
_PARTED, _HIGH, _PARTED_HIGH = _class(0x80, 0x10000), re.compile("[\U00010000-\U0010ffff]"), _class(0x10000, 0x20000)
#: A run of more than LONGEST characters is read as pieces of PIECE, each half over the next, so that all of it counts.
LONGEST, PIECE = 40, 20


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and marks, as UTF-8; the pieces of long runs in their place."""
    text = text.lower()
    if not text.isascii():
        text = _PARTED.sub(" ", text)
        if _HIGH.search(text):
            text = _HIGH.sub(lambda m: " " if _PARTED_HIGH.match(m[0]) else m[0], text)
    found = text.encode("utf-8", "replace").translate(_BLANK).split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [piece for word in found for piece in pieces(word)]


def pieces(word: bytes) -> list[bytes]:
    """The word, or if it is long the pieces whose starts are half a piece apart: every PIECE // 2 characters stand whole in one."""
    chars = word.decode("utf-8", "replace") if len(word) > LONGEST else ""
    if len(chars) <= LONGEST:
        return [word]
    step = PIECE // 2
    return [chars[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(chars) - step, step)]


def gram_ids(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Hashed n-grams of a word's characters between its edges."""
    chars = "<" + word.decode("utf-8", "replace") + ">"
    out = [zlib.crc32(chars[i : i + n].encode()) % buckets for n in GRAMS for i in range(len(chars) - n + 1)]
    return out or [zlib.crc32(chars.encode()) % buckets]


def text_parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters; no word is cut, and one longer than a part makes the part longer."""
    start, size = 0, PART
    while len(text) - start > size:
        end = start + size
        while end > start and not _parts_words(text[end - 1]):
            end -= 1
        if end == start:
            size *= 2
            continue
        yield text[start:end]
        start, size = end, PART
    yield text[start:]


def _parts_words(char: str) -> bool:
    return not char.isalnum() if char.isascii() else bool(_PARTED.match(char) or _PARTED_HIGH.match(char))


class Model:
    """One number for each n-gram bucket, a bias, and the scale of both: the collapsed softmax."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)


class Scorer:
    def __init__(self, model: Model) -> None:
        self._weights, self._bias, self._known = model.weights.tolist(), model.bias, {}

    def _word(self, word: bytes) -> float:
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        ids = gram_ids(word, len(self._weights))
        weights = self._weights
        value = self._known[word] = sum([weights[i] for i in ids]) / len(ids)
        return value

    def margin(self, text: str | None) -> float:
        """Log odds of the worst window; the bias alone for a text without words."""
        worst, held, known, word = None, [], self._known, self._word
        for part in text_parts(text or ""):
            values = held + [known[w] if w in known else word(w) for w in tokens(part)]
            if len(values) < WINDOW:
                held = values
                continue
            sums = np.array(values)
            sums = sum(sums[k : len(sums) - WINDOW + 1 + k] for k in range(WINDOW)) / WINDOW
            worst = max(float(sums.max()), -np.inf if worst is None else worst)
            held = values[len(values) - WINDOW + 1 :]
        if worst is None:
            worst = sum(held) / WINDOW if held else 0.0
        return worst + self._bias

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def train(texts: list[str], labels: list[int], epochs: int = 60, warm: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit vectors and softmax together with Adam; deterministic.

    The first `warm` epochs average each text's distinct words; the others average the window that
    is worst at the time.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():  # one class only: its share is all there is to know
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)], np.int32) for t in texts]
    pad = len(vocabulary)  # a word of no n-grams that fills up texts shorter than a window
    docs = [np.concatenate([d, np.full(max(0, WINDOW - len(d)), pad, np.int32)]) for d in docs]
    every, counts = array("H"), array("i")
    for w in vocabulary:
        ids = gram_ids(w)
        every.extend(ids)
        counts.append(len(ids))
    del vocabulary
    flat = np.frombuffer(every, np.uint16)
    sizes = np.append(np.frombuffer(counts, np.int32), 0).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    cuts = [*range(0, pad, SLICE), pad]  # words are worked on in slices, so that their n-grams need little memory

    def word_numbers(per_bucket: np.ndarray) -> np.ndarray:
        sums = np.zeros(pad + 1)
        for a, b in zip(cuts, cuts[1:]):
            sums[a:b] = np.add.reduceat(per_bucket[flat[begin[a] : begin[b]]], begin[a:b] - begin[a])
        return sums / np.maximum(sizes, 1)

    def spread_over_buckets(per_word: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for a, b in zip(cuts, cuts[1:]):
            live = a + np.flatnonzero(per_word[a:b])
            count = sizes[live]
            at = np.repeat(begin[live] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            out += np.bincount(flat[at], np.repeat(per_word[live], count), BUCKETS)
        return out

    n_docs = len(docs)
    # (text, distinct word) pairs for the warm epochs
    distinct = [np.unique(d) for d in docs]
    pair_doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(d) for d in distinct])
    pair_word = np.concatenate(distinct)
    per_doc = np.bincount(pair_doc, minlength=n_docs).astype(np.float64)
    # every window start, text by text
    all_words = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    starts = np.concatenate([np.arange(f, f + n - WINDOW + 1, dtype=np.int32) for f, n in zip(first, lengths)])
    start_first = np.concatenate(([0], np.cumsum(lengths - WINDOW + 1)[:-1]))
    start_doc = np.repeat(np.arange(n_docs, dtype=np.int32), lengths - WINDOW + 1)
    del docs, texts

    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    head = np.stack([-np.ones(DIM), np.ones(DIM)], 1) * rng.uniform(0.5, 1.0, (DIM, 1))
    bias = np.array([np.log(1 - y.mean()), np.log(y.mean())])
    parameters = [vectors, head, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        direction = head[:, 1] - head[:, 0]
        numbers = word_numbers(vectors @ direction)
        if epoch < warm:
            margin = np.bincount(pair_doc, numbers[pair_word], n_docs) / per_doc
            used_doc, used_word, used_weight = pair_doc, pair_word, 1 / per_doc[pair_doc]
        else:
            windows = sum(numbers[all_words[starts + k]] for k in range(WINDOW)) / WINDOW
            margin = np.maximum.reduceat(windows, start_first)
            hit = np.flatnonzero(windows == margin[start_doc])
            place = starts[hit]
            owner = start_doc[hit]
            owner, once = np.unique(owner, return_index=True)
            place = place[once]
            used_doc = np.repeat(owner, WINDOW)
            used_word = (all_words[place[:, None] + np.arange(WINDOW)]).ravel()
            used_weight = np.full(len(used_word), 1 / WINDOW)
        odds = margin + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) * balance
        # d loss / d (mean vector of a text) = error * direction; spread over its words' n-grams
        share = np.bincount(used_word, error[used_doc] * used_weight, len(sizes)) / np.maximum(sizes, 1)
        on_bucket = spread_over_buckets(share) / n_docs
        gradients = [
            on_bucket[:, None] * direction[None, :] + decay * vectors,
            np.stack([-(vectors.T @ on_bucket), vectors.T @ on_bucket], 1) + decay * head,
            np.array([-error.mean(), error.mean()]),
        ]
        for p, g, (m, v) in zip(parameters, gradients, moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return Model(vectors @ (head[:, 1] - head[:, 0]), float(bias[1] - bias[0]))


def _best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin from which on to call a text toxic, by F1 of texts that a model has not seen."""
    order = np.argsort(-margins, kind="stable")
    ranked, truth = margins[order], y[order]
    hits = np.cumsum(truth)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # a cut can't part equal margins
    best = int(f1.argmax())
    below = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1
    return float((ranked[best] + below) / 2)


def calibrated(model: Model, margins: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD) -> Model:
    """The model with its bias moved so that `threshold` falls on the best cut of margins of unseen texts."""
    if not len(labels):
        return model
    return Model(model.weights, model.bias + float(np.log(threshold / (1 - threshold))) - _best_cut(margins, labels))


def train_fold(texts: list[str], labels: list[int], fold: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model of a fold, and margins and labels of rows it has not seen.

    Folds 0 and 1 learn from every other row and leave the rest unseen; fold 2 learns from all rows.
    Halves that lack a class teach nothing about the cut: there, and in fold 2, nothing is left unseen.
    """
    y = np.asarray(labels, np.float64)
    none = np.zeros(0)
    if fold == 2:
        return train(texts, labels), none, none
    unseen = np.arange(len(y)) % 2 == fold
    if any(len(set(y[half])) < 2 for half in (unseen, ~unseen)):
        return Model(np.zeros(BUCKETS), 0.0), none, none
    model = train([texts[i] for i in np.flatnonzero(~unseen)], y[~unseen].tolist())
    scorer = Scorer(model)
    return model, np.array([scorer.margin(texts[i]) for i in np.flatnonzero(unseen)]), y[unseen]


def train_calibrated(texts: list[str], labels: list[int], threshold: float = THRESHOLD) -> Model:
    """All three folds here: the model of all rows, cut where the halves' models part the texts they have not seen."""
    (_, m0, y0), (_, m1, y1), (model, _, _) = (train_fold(texts, labels, fold) for fold in range(3))
    return calibrated(model, np.concatenate([m0, m1]), np.concatenate([y0, y1]), threshold)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows (doc_id, text, label): labelled documents that `learn` admits, chosen by hash of doc_id.

    Labels without a document take no place. A doc_id with several texts gives the one of least hash, one
    with several labels the largest; null texts are left out. The chosen ids, `rows` at most, are broadcast.
    """
    ids = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    ids = ids.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    found = texts.join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"), F.max("label").alias("label"))
    return one.select("doc_id", F.col("one.text").alias("text"), "label")


_FOLD = [("fold", pa.int32()), ("weights", pa.binary()), ("bias", pa.float64()), ("margins", pa.binary()), ("labels", pa.binary())]


def _train_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fold, text, label), in order of doc_id: one row for each fold."""
    held: dict[int, tuple[list[str], list[int]]] = {}
    for batch in batches:
        for fold, text, label in zip(*(c.to_pylist() for c in batch.columns)):
            texts, labels = held.setdefault(fold, ([], []))
            texts.append(text)
            labels.append(label)
    for fold in sorted(held):
        model, margins, seen = train_fold(*held.pop(fold), fold)
        row = (fold, model.weights.tobytes(), model.bias, margins.tobytes(), seen.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FOLD)], [n for n, _ in _FOLD])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of the labelled rows that `learn` (over doc_id) admits.

    The three folds are trained side by side in tasks of their own (each holds `rows` texts at most);
    the driver gets their weights and the margins of unseen rows.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, rows)
    folds = materialize(sample, "toxic-sample").withColumn("fold", F.explode(F.array(*map(F.lit, range(3)))))
    folds = folds.repartitionByRange(3, "fold").sortWithinPartitions("fold", "doc_id").select("fold", "text", "label")
    found = folds.mapInArrow(_train_folds, "fold int, weights binary, bias double, margins binary, labels binary").collect()
    if not found:  # no labelled row at all
        return train([], [])
    model = next(Model(np.frombuffer(r["weights"], np.float32), r["bias"]) for r in found if r["fold"] == 2)
    halves = sorted((r for r in found if r["fold"] < 2), key=lambda r: r["fold"])
    margins, seen = (np.concatenate([np.frombuffer(r[name]) for r in halves]) for name in ("margins", "labels"))
    return calibrated(model, margins, seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get what the bias alone says.

    The longest texts are scored part by part; repeated rows score alike; an empty table gives an
    empty result; columns beside doc_id and text are ignored.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.probability(row[1]) for row in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])
        del scorer
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns; nulls in any column stay."""
    schema = docs.schema
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            mask = pa.array([scorer.probability(text) < threshold for (text,) in rows_of(batch.select([at]))], pa.bool_())
            yield batch.filter(mask)
        del scorer
        give_back()

    return docs.mapInArrow(kept, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(doc_key(doc_id), F.lit(4)) == 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    rows = score(docs, model)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
