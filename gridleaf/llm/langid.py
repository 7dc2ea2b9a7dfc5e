"""Operator 7: language identification by prediction by partial matching.

Each language has a byte context tree of order up to ORDER: for every context of the
last bytes, the counts of what followed. A byte costs its code length in the longest
context that has been seen, with escape probability d / (n + d) (method C: n symbols
seen in the context, d of them distinct) on the way down to order 0 and a uniform code.
Statistics are frozen after training, so every byte's cost is a table entry: a dense
table for the context of two bytes, and a sorted list of the four-byte strings that some
language has seen. A text's language is the one with the shortest code.

Texts are lower-cased in ASCII; runs of bytes other than letters and bytes over 127 count
as one space. Training takes at most TRAIN_DOCS texts a language (least hash first, of at
most TRAIN_BYTES bytes), whole texts. Every labelled language is learned; each BLOCK of them,
those of like alphabets together, has tables of its own over the bytes it has seen, so tables
grow with the languages. Bytes that a block has never seen have one symbol there, which is
exact: all of them cost the escapes and the uniform code of one byte in SYMBOLS.

Defined cases: null text, empty text or text without a letter is ``und`` with score 0;
rows with a null language are not learned from; without training rows all is ``und``.
Ties go to the language that sorts first. Repeated rows and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, lookup, released, small_batches, table

ORDER = 3
TRAIN_DOCS = 600
TRAIN_BYTES = 50_000
BLOCK = 8
SYMBOLS = 256
UND = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _folded(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of space as one and a space before each text; new offsets."""
    offs = chunk.offs + np.arange(len(chunk.offs))
    size = int(offs[-1])
    out = np.full(size, 32, np.uint8)
    if len(chunk.buf):
        lead = np.repeat(np.arange(1, len(chunk.offs)), np.diff(chunk.offs))
        out[np.arange(len(chunk.buf)) + lead] = _FOLD[chunk.buf]
    keep = np.ones(size, bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offs[:-1][offs[:-1] < size]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[offs]


class Model:
    """Frozen context trees of all languages as tables of code lengths in bits."""

    def __init__(self, langs: list[str], texts: list[list[bytes]]):
        """texts: the folded training texts of each language."""
        self.langs = langs
        joined = [b"".join(t) for t in texts]
        self.learned = sum(map(len, joined))  # bytes
        self.blocks: list[tuple[list[int], Model]] = []  # (places of its languages, model)
        if len(langs) > BLOCK:
            counts = [np.bincount(np.frombuffer(data, np.uint8), minlength=256) for data in joined]
            order = sorted(range(len(langs)), key=lambda k: (int(counts[k][128:].argmax()), int((counts[k] > 0).sum()), k))
            for at in range(0, len(order), BLOCK):
                own = order[at : at + BLOCK]
                self.blocks.append((own, Model([langs[k] for k in own], [[joined[k]] for k in own])))
            return
        seen = np.bincount(np.frombuffer(b"".join(joined), np.uint8), minlength=256) if langs else np.zeros(256)
        top = np.flatnonzero(seen)
        self.size = s = len(top) + 1
        self.symbol = np.full(256, len(top), np.int64)
        self.symbol[top] = np.arange(len(top))
        self.space = int(self.symbol[32])
        n = len(langs)
        base = np.full((1, s, n), np.log2(SYMBOLS), np.float32)  # order -1: uniform
        low = np.zeros((s**2, s, n), np.float32)
        grams, costs3, esc3 = [], [], np.zeros((s**3, n), np.float32)
        for k, data in enumerate(joined):
            sym = self.symbol[np.frombuffer(data, np.uint8)]
            cost = base[:, :, k].astype(np.float64)  # [contexts, symbols]
            for order in range(ORDER):
                ctx = self._context(sym, order)
                count = np.bincount(ctx[order:] * s + sym[order:], minlength=s ** (order + 1)).reshape(-1, s) if len(sym) > order else np.zeros((s**order, s))
                cost = self._level(count, np.tile(cost, (count.shape[0] // cost.shape[0], 1)))
            low[:, :, k] = cost
            if len(sym) > ORDER:
                key, c = np.unique(self._context(sym, ORDER)[ORDER:] * s + sym[ORDER:], return_counts=True)
            else:
                key, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
            total = np.bincount(key // s, weights=c, minlength=s**3)
            kinds = np.bincount(key // s, minlength=s**3)
            esc3[:, k] = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            grams.append(key)
            costs3.append((key, -np.log2(c / (total + kinds)[key // s])))
        self.low = low.reshape(s**3, n)  # [two context symbols and the next one]
        self.esc3 = esc3
        self.keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.high = self.esc3[self.keys // s] + self.low[self.keys % s**3]
        for k, (key, c) in enumerate(costs3):
            self.high[np.searchsorted(self.keys, key), k] = c
        # bit map of the strings in keys, so that most others need no search
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 7) & ((1 << 22) - 1)

    def _context(self, sym: np.ndarray, order: int) -> np.ndarray:
        """Index of the order symbols before each position (0 where the text is too short)."""
        ctx = np.zeros(len(sym), np.int64)
        for j in range(order, 0, -1):
            ctx[order:] = ctx[order:] * self.size + sym[order - j : len(sym) - j]
        return ctx

    @staticmethod
    def _level(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Costs of one order from its counts and the costs of the order below, for all contexts."""
        n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        escape = -np.log2(np.maximum(d, 1) / np.maximum(n + d, 1))
        with np.errstate(divide="ignore"):
            own = -np.log2(count / np.maximum(n + d, 1))
        return np.where(n == 0, lower, np.where(count > 0, own, escape + lower))

    def code_lengths(self, folded: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[texts, languages] bits of each whole text; contexts never reach into the text before."""
        n = len(folded)
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if not n or not self.langs:
            return out
        if self.blocks:
            for own, model in self.blocks:
                out[:, own] = model.code_lengths(folded, offs)
            return out
        s = self.size
        sym = self.symbol[folded]
        prev = []
        for j in (3, 2, 1):
            p = np.full(n, self.space, np.int64)
            p[j:] = sym[:-j]
            for t in range(j):  # the first bytes of a text follow spaces
                at = offs[:-1] + t
                p[at[at < offs[1:]]] = self.space
            prev.append(p)
        key2 = (prev[1] * s + prev[2]) * s + sym
        key = prev[0] * s**3 + key2
        cost = self.low[key2] + self.esc3[key // s]
        maybe = np.flatnonzero(self.bits[self._slot(key)])
        at = lookup(self.keys, key[maybe])
        hit = at >= 0
        cost[maybe[hit]] = self.high[at[hit]]
        total = np.zeros((n + 1, cost.shape[1]))
        np.cumsum(cost, 0, out=total[1:], dtype=np.float64)
        return total[offs[1:]] - total[offs[:-1]]

    def predict(self, chunk) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits a byte in that language) of each text of a chunk."""
        folded, offs = _folded(chunk)
        bits = self.code_lengths(folded, offs)
        letters = np.concatenate([[0], np.cumsum(_letters(chunk))])
        none = letters[chunk.offs[1:]] == letters[chunk.offs[:-1]]
        if not self.langs:
            return [UND] * len(none), np.zeros(len(none)), np.zeros(len(none))
        best = bits.argmin(1)
        # posterior of the languages under a code length per 8 bytes of evidence
        p = np.exp2(-np.clip((bits - bits.min(1, keepdims=True)) / 8, 0, 60))
        score = np.where(none, 0.0, 1 / p.sum(1))
        size = np.maximum(1, np.diff(offs))
        return [UND if u else self.langs[i] for u, i in zip(none, best, strict=True)], score, bits[np.arange(len(best)), best] / size


def _letters(chunk) -> np.ndarray:
    """Marks bytes of letters: ASCII ones, and characters beyond ASCII that are letters."""
    buf = chunk.buf
    mark = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    if len(buf) and (buf >= 128).any():
        for i in np.flatnonzero(~np.logical_or.reduceat(np.append(mark, False), chunk.offs[:-1]) | (np.diff(chunk.offs) == 0)):
            a, b = chunk.offs[i], chunk.offs[i + 1]
            if b > a and any(c.isalpha() for c in bytes(buf[a:b]).decode("utf-8", "replace")):
                mark[a] = True
    return mark


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "order") -> Model:
    """The model of all languages, each of at most TRAIN_DOCS texts."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(order_col).alias("order"), F.col(text_col).alias("text"))
    rows = rows.where(F.octet_length("text") <= TRAIN_BYTES)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    texts: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    # a hash cut by language leaves about 1.5 TRAIN_DOCS rows of each, whatever the size of the table; then a rank decides
    cuts = {k: -(1 << 63) + int((1 << 64) * (1.5 * TRAIN_DOCS + 200) / n) for k, n in counts.items() if n > 2 * TRAIN_DOCS + 200}
    if cuts:
        cut = rows.sparkSession.createDataFrame(list(cuts.items()), "of string, cut long")
        rows = rows.join(F.broadcast(cut), F.col("lang") == F.col("of"), "left").where(F.col("cut").isNull() | (F.col("order") <= F.col("cut"))).select("lang", "order", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    got = rows.withColumn("rank", rank).where(F.col("rank") <= TRAIN_DOCS).select("lang", "text", "rank").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    langs = np.array(got["lang"].to_pylist(), object)
    for lang in texts:
        own = got["text"].take(pa.array(np.flatnonzero(langs == lang))).combine_chunks()
        for c in chunks(own):
            folded, offs = _folded(c)
            texts[lang] += [folded[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return Model(list(texts), list(texts.values()))


def predict_language(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns {prefix}lang_pred, {prefix}score and {prefix}bits_per_byte appended, in place of such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}bits_per_byte"]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, bits = [], [], []
            for c in chunks(batch.column(at), 1 << 18):
                a, b, d = shared.value.predict(c)
                langs += a
                scores.append(b)
                bits.append(d)
            if langs:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(bits))], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"])
    return docs.mapInArrow(released(run), schema)


def _fold5(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(_fold5() != 0).select("text", "lang", F.xxhash64("doc_id").alias("order"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold5() == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: The pipeline rejects a text whose code in the best language is longer than that of random bytes (8 bits each)
#: by this many bits, so the odds that it is in a learned language are under one in 2**EXCESS.
EXCESS = 64
#: Training bytes below which the trees have seen too few contexts to call a text foreign.
LEARNED = 1 << 16


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without a language go; all others stay, unchanged.

    These are null texts, texts without a letter, and texts that random bytes explain better than
    every learned language does (noise, or a script without a labelled document; see EXCESS).
    Where fewer than LEARNED bytes are labelled, texts with a letter stay.
    """
    small_batches(spark)
    model = fit(training_rows(docs))
    found = predict_language(docs, model, prefix="__lid_")
    spoken = F.col("__lid_lang_pred") != UND
    if not model.langs:
        spoken = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    elif model.learned >= LEARNED:
        spoken &= (F.col("__lid_bits_per_byte") - 8) * F.octet_length("text") < EXCESS
    return found.where(spoken).select(*(F.col(f"`{c}`") for c in docs.columns))
