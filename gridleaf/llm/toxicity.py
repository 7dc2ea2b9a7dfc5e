"""Operator 1: convolutional toxicity classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 3 to 6 bytes, so a
word never seen is placed by its stem. Filters of widths 1, 2 and 3 run over all words
of a text; each filter's maximum over the whole text feeds a logistic output. Thresholds
are calibrated by language: the raw decision threshold of each language group that
separates training labels best is mapped to a score of 0.7. The group is guessed from
the text's own function words; no column but the text enters a score.

Labels are learned from a bounded sample: at most TRAIN_DOCS labelled rows (least hash of
the id first) of at most TRAIN_BYTES bytes each, whole texts. Scoring covers every whole text.

Defined cases: null and empty texts, and texts without a word, get the model's score of
no evidence. Rows without a label, or with a null one, are not learned from; with no
labelled row, or none of one kind, all scores equal the share of toxic labels (0 if none).
Repeated ids of a label count once per row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTES_LOWER, chunks, hash_word, least_hashed, mix, powers, released, small_batches, split_words, table, word_hashes

TRAIN_DOCS = 6000
TRAIN_BYTES = 100_000
BUCKETS = 1 << 15
DIM = 12
FILTERS = 6
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
EPOCHS = 12
THRESHOLD = 0.7

#: Function words by which a text's language group is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for was with on as are this by from be or at have not".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "le la les et des du un une que qui dans est pour pas au sur par plus avec ce il en".split(),
    "es": "el los las del que una por con no se su al lo como más para es y en la".split(),
}

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _features(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids [words, features], whole-word hashes, first word of each text)."""
    words = split_words(chunk, _WORD[chunk.buf] if len(chunk.buf) else None)
    values = _BYTES_LOWER[chunk.buf]
    with np.errstate(over="ignore"):
        pw, inv = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pw[:-1], out=total[1:])
        cols = []
        for k, n in enumerate((0, *PREFIXES)):
            end = words.end if not n else np.minimum(words.start + n, words.end)
            h = mix((total[end] - total[words.start]) * inv[words.start])
            cols.append(((h ^ (h >> np.uint64(17))) + np.uint64(k * 0x5851)) % np.uint64(BUCKETS))
    return np.stack(cols, 1).astype(np.int32) if len(words.start) else np.zeros((0, 1 + len(PREFIXES)), np.int32), word_hashes(chunk, words, lower=True), words.first


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    langs = sorted(FUNCTION_WORDS)
    pairs = sorted((hash_word(w, lower=True), i) for i, k in enumerate(langs) for w in FUNCTION_WORDS[k])
    hashes = np.array([h for h, _ in pairs], np.uint64)
    keys, at = np.unique(hashes, return_inverse=True)
    votes = np.zeros((len(keys), len(langs)), np.float32)
    for row, (_, i) in zip(at, pairs, strict=True):
        votes[row, i] += 1
    return keys, votes / votes.sum(1, keepdims=True)


_KEYS, _VOTES = _language_table()


def _groups(whole: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Language group of each text by its function words: 0 to 3, or 4 where none occurs."""
    at = np.searchsorted(_KEYS, whole)
    at[at == len(_KEYS)] = 0
    hit = np.flatnonzero(_KEYS[at] == whole)
    total = np.zeros((len(whole) + 1, _VOTES.shape[1]), np.float64)
    total[hit + 1] = _VOTES[at[hit]]
    total = np.cumsum(total, 0)
    sums = total[first[1:]] - total[first[:-1]]
    return np.where(sums.any(1), sums.argmax(1), _VOTES.shape[1])


def _layout(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first row of each text, row of each word, rows): texts are parted by zero rows, and an empty
    one has a zero row of its own, so no window reaches into the next text."""
    counts, pad = np.diff(first), max(WIDTHS) - 1
    room = np.maximum(counts, 1) + pad
    begin = np.cumsum(room) - room
    return begin, np.arange(first[-1]) + np.repeat(begin - first[:-1], counts), int(room.sum()) + pad


class Net:
    """Embedding -> filters -> maximum over the text -> logistic."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.W = {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(-2.0)
        self.cut = np.zeros(_VOTES.shape[1] + 1, np.float32)  # raw decision threshold by group
        self.steep = np.float32(1.0)

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(maxima [texts, filters], position of each, padded embeddings); texts are parted by zero rows."""
        counts = np.diff(first)
        begin, row, size = _layout(first)
        x = np.zeros((size, DIM), np.float32)
        if len(ids):
            e = self.E[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                e += self.E[ids[:, k]]
            x[row] = e
        best, where = [], []
        ends = begin + np.maximum(counts, 1)
        for w in WIDTHS:
            n = size - w + 1
            y = x[:n] @ self.W[w][:DIM]
            for j in range(1, w):
                y += x[j : j + n] @ self.W[w][j * DIM : (j + 1) * DIM]
            np.maximum(y, 0, out=y)
            cuts = np.minimum(np.stack([begin, ends], 1).ravel(), n - 1)
            best.append(np.maximum.reduceat(y, cuts, axis=0)[::2])
            where.append(y)
        return np.concatenate(best, 1), (begin, ends, where), x

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.out + self.bias

    def score(self, ids: np.ndarray, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
        """0 to 1; a raw value at its group's threshold scores THRESHOLD."""
        z = (self.raw(ids, first) - self.cut[_groups(whole, first)]) * self.steep + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[np.ndarray], groups: np.ndarray, labels: np.ndarray, seed: int = 11) -> Net:
    """texts: bucket ids [words, features] of each text; groups: their language groups."""
    net = Net(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        net.out[:] = 0
        net.bias = np.float32(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        net.cut[:] = net.bias - np.float32(0) if share == 1.0 else np.float32(0)
        return net
    rng = np.random.default_rng(seed)
    grads = {"out": np.zeros_like(net.out), "bias": 0.0, "E": np.zeros((BUCKETS, 1), np.float32)} | {w: np.zeros_like(net.W[w]) for w in WIDTHS}
    weight = np.where(labels == 1, min(4.0, (1 - share) / share), 1.0).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = 0.08 * (1 - epoch / EPOCHS) + 0.01
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
            ids = np.concatenate([texts[i] for i in part])
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            best, (begin, ends, maps), x = net.pooled(ids, first)
            p = 1 / (1 + np.exp(-np.clip(best @ net.out + net.bias, -30, 30)))
            d = (p - labels[part]) * weight[part] / len(part)
            d_best = d[:, None] * net.out[None, :] * (best > 0)
            _step(net, "out", best.T @ d + 1e-5 * net.out, grads, rate)
            grads["bias"] += float(d.sum()) ** 2
            net.bias -= np.float32(rate * d.sum() / (np.sqrt(grads["bias"]) + 1e-6))
            dx_rows, dx_vals = [], []
            for k, w in enumerate(WIDTHS):
                dw = np.zeros_like(net.W[w])
                for i in range(len(part)):
                    cols = np.flatnonzero(d_best[i, k * FILTERS : (k + 1) * FILTERS])
                    if not len(cols):
                        continue
                    at = begin[i] + maps[k][begin[i] : ends[i]][:, cols].argmax(0)
                    g = d_best[i, k * FILTERS + cols]
                    for j in range(w):
                        dw[j * DIM : (j + 1) * DIM, cols] += x[at + j].T * g
                        dx_rows.append(at + j)
                        dx_vals.append(net.W[w][j * DIM : (j + 1) * DIM, cols].T * g[:, None])
                _step(net, w, dw + 1e-5 * net.W[w], grads, rate)
            if dx_rows and len(ids):
                row_of = np.full(len(x), -1)
                row_of[_layout(first)[1]] = np.arange(len(ids))
                rows = row_of[np.concatenate(dx_rows)]
                vals = np.concatenate(dx_vals)[rows >= 0]
                rows = rows[rows >= 0]
                flat, vals = ids[rows].ravel(), np.repeat(vals, ids.shape[1], 0)
                uniq, inv = np.unique(flat, return_inverse=True)
                g = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(g, inv, vals)
                grads["E"][uniq] += (g**2).mean(1, keepdims=True)
                net.E[uniq] -= rate * g / (np.sqrt(grads["E"][uniq]) + 1e-4)
    _calibrate(net, texts, groups, labels)
    return net


def _step(net: Net, key, grad: np.ndarray, grads: dict, rate: float) -> None:
    grads[key] += grad**2
    value = net.out if key == "out" else net.W[key]
    value -= (rate * grad / (np.sqrt(grads[key]) + 1e-6)).astype(np.float32)


def _calibrate(net: Net, texts: list[np.ndarray], groups: np.ndarray, labels: np.ndarray) -> None:
    """Per language group, the raw threshold midway between labels with the best balanced accuracy."""
    raw = []
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        raw.append(net.raw(np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])])))
    raw = np.concatenate(raw)
    net.cut[:] = _best_cut(raw, labels)
    for g in range(len(net.cut)):
        own = groups == g
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= 10:
            net.cut[g] = _best_cut(raw[own], labels[own])


def _best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(raw, kind="stable")
    r, y = raw[order], labels[order]
    tpr = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    tnr = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    good = tpr + tnr >= (tpr + tnr).max() - 1e-9
    at = int(np.median(np.flatnonzero(good)))
    return float(r[0] - 1 if at == 0 else r[-1] + 1 if at == len(r) else (r[at - 1] + r[at]) / 2)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            ids, whole, first = _features(c)
            yield pa.RecordBatch.from_arrays([
                batch.column("label").slice(c.lo, c.hi - c.lo).cast(pa.int32()),
                pa.array([ids[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                pa.array(_groups(whole, first).astype(np.int32)),
            ], ["label", "ids", "group"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "order") -> Net:
    """labelled: text, label 0/1 and a value whose least TRAIN_DOCS rows form the sample."""
    sample = labelled.where(F.col(label_col).isNotNull() & (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= TRAIN_BYTES))
    sample = sample.select(F.col(order_col).alias("order"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")).orderBy("order", "label").limit(TRAIN_DOCS)
    got = sample.select("label", "text").mapInArrow(released(_featurise), "label int, ids binary, group int").toArrow()
    texts = [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in got["ids"]]
    return train(texts, got["group"].to_numpy().astype(np.int64), got["label"].to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(shared.value.score(*_features(c)), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(scored), f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").alias("labelled"), F.col("toxic").alias("label"))
    # choose the sample on ids alone; its rows are at most TRAIN_DOCS and some more for long texts
    usable = labels.withColumn("order", F.xxhash64("labelled")).where(F.pmod(F.crc32(F.col("labelled").cast("string")), F.lit(3)) != 1)
    most = TRAIN_DOCS * 5 // 4
    chosen = least_hashed(usable, "order", most, usable.count()).orderBy("order", "label").limit(most)
    net = fit(docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["labelled"]))
    return score_toxicity(docs, net).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
