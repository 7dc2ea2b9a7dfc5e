"""Operator 8: benchmark decontamination by latent semantic retrieval.

Documents are read in blocks of BLOCK words; a passage is two blocks in a row, so passages
overlap by half. Words of the benchmark are features of their own, all other words of the
corpus share HASHED features by hash, so the space's size does not grow with the corpus.
1. Distributed randomised SVD. One pass over all passages counts document frequencies and
   multiplies the TF-IDF term matrix by its transpose and a random block of RANK columns
   (words are weighed by their frequency in the chunk that is read, frequent ones by 0); tasks
   add up their share, Spark sums the rows by feature. The singular value decomposition of the
   sum gives each word a vector of unit length: words of like passages lie near each other.
2. Candidate search. The similarity of a passage and an item is the share of the item's TF-IDF
   weight that the passage holds, and where their latent vectors have cosine NEAR or more, plus
   LATENT times the share of the item's latent vector: a replaced word still counts by the
   company it keeps. The first comes from sparse postings, the second from word tables of RANK
   columns; nothing is as large as items x words. Passages with similarity CONTAINED or more
   and cosine COSINE or more are candidates. An item longer than a passage is searched whole
   and in parts of a passage's length at most, each by itself.
3. Checks. The longest common subsequence of item and passage, and the answer (the distinct
   words of the item's last sentence, or its last quarter), decide: a text contains an item if
   lcs_ratio >= EXACT, or lcs_ratio >= PARAPHRASE and answer_ratio >= ANSWER.

Words are runs of letters, digits and bytes over 127, A-Z lower-cased. Every passage of every
whole text is searched against every item. The benchmark is taken to fit the driver (it is
collected); a check raises beyond MAX_ITEM_BYTES.

Defined cases: null and empty texts contain nothing; null or wordless items are never found;
equal items are each reported; repeated rows are reported once each; an empty benchmark or
table gives no pair. Null ids are reported as null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, chunks, lookup, numbered, released, small_batches, split_words, table, without_rows, word_hashes

BLOCK = 24
RANK = 32
HASHED = 1 << 14
COMMON = 0.1
#: Words in more than this share of the passages (and OFTEN more) have no latent vector.
FREQUENT, OFTEN = 0.02, 20
LATENT = 0.5
NEAR = 0.8
COSINE = 0.1
CONTAINED = 0.3
EXACT = 0.85
PARAPHRASE = 0.55
ANSWER = 0.6
MAX_ITEM_BYTES = 64_000_000
#: Cells of the array of passages x items that is held at once.
CELLS = 1 << 21

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _words(c) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(c, _WORD[c.buf] if len(c.buf) else None)
    return word_hashes(c, words, lower=True), words.first


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Benchmark:
    """Items as word hashes, their postings, and after fit() their latent vectors."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.items, self.answers, self.share = [], [], [], LATENT
        for i, text in zip(ids, texts, strict=True):
            parts = [s for s in (text or "").replace("\n", " ").replace("?", ".").replace("!", ".").split(".") if s.strip()]
            (h,) = [_words(c)[0] for c in chunks(pa.array([text or ""], pa.string()))]
            if not len(h):
                continue
            (tail,) = [_words(c)[0] for c in chunks(pa.array([parts[-1] if len(parts) > 1 else ""], pa.string()))]
            self.ids.append(i)
            self.items.append(h)
            self.answers.append(np.unique(tail if len(tail) >= 3 else h[-max(3, len(h) // 4) :]))
        words, df = np.unique(np.concatenate([np.unique(h) for h in self.items]) if self.items else np.zeros(0, np.uint64), return_counts=True)
        keep = df <= max(2, COMMON * len(self.items))
        for h in self.items:  # the rarest words of an item of common words only
            at = lookup(words, np.unique(h))
            keep[at[np.argsort(df[at], kind="stable")[:5]]] = True
        self.words = Slots(words[keep].view(np.int64))
        self.own = int(keep.sum())  # features of the benchmark's words; the hashed ones follow
        self.size = self.own + HASHED
        # what is searched: all items, then the parts of those longer than a passage; of_item is the item of each
        self.parts, self.of_item = list(self.items), list(range(len(self.items)))
        for i, h in enumerate(self.items):
            if len(h) > 2 * BLOCK:
                self.parts += np.array_split(h, -(-len(h) // (2 * BLOCK)))
                self.of_item += [i] * (len(self.parts) - len(self.of_item))
        self.random = np.random.default_rng(3).normal(size=(self.size, RANK)).astype(np.float32)

    def features(self, h: np.ndarray) -> np.ndarray:
        """Features of word hashes: the benchmark's words below own."""
        at = self.words.find(h.view(np.int64))
        return np.where(at >= 0, at, self.own + (h >> np.uint64(33)).astype(np.int64) % HASHED).astype(np.uint16 if self.size < 1 << 16 else np.int32)

    def fit(self, passages: int, df: np.ndarray, sketch: np.ndarray) -> None:
        """df and sketch by feature, from all passages."""
        self.idf = np.log((2.0 + passages) / (1.0 + df))
        u, s, _ = np.linalg.svd(sketch, full_matrices=False)
        vectors = u * s
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        vectors -= vectors[df > 0].mean(0) if (df > 0).any() else 0.0
        rare = (df > 0) & (df <= FREQUENT * passages + OFTEN)
        self.basis = (np.where(rare, self.idf, 0.0)[:, None] * vectors).astype(np.float32)  # latent vector that a word adds
        feature, part, weight, latent = [], [], [], []
        self.norm = np.zeros(len(self.parts))
        for k, h in enumerate(self.parts):
            f = self.features(h).astype(np.int64)
            latent.append(self.basis[f].sum(0))
            words, tf = np.unique(f[f < self.own], return_counts=True)
            total = float(((tf * self.idf[words]) ** 2).sum())
            self.norm[k] = np.sqrt(total)
            feature.append(words)
            part.append(np.full(len(words), k))
            weight.append(tf * self.idf[words] ** 2 / max(total, 1e-12))
        # postings: feature f adds weight[j] to part[j] for j in first[f]:first[f + 1]
        feature = np.concatenate(feature)
        order = np.argsort(feature, kind="stable")
        self.part, self.weight = np.concatenate(part)[order], np.concatenate(weight)[order].astype(np.float32)
        self.first = np.searchsorted(feature[order], np.arange(self.own + 1))
        latent = np.array(latent).reshape(len(self.parts), -1)
        self.size_latent = np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
        self.latent = (latent / self.size_latent[:, None]).T.copy()


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, text of each block, first block of each text)."""
    n = np.diff(first)
    blocks = -(-n // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    text = np.repeat(np.arange(len(n)), n)
    return base[text] + (np.arange(int(first[-1])) - first[text]) // BLOCK, np.repeat(np.arange(len(n)), blocks), base


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _sketch(docs: DataFrame, bench: Benchmark) -> tuple[int, np.ndarray, np.ndarray]:
    """(passages, document frequencies, transpose @ (terms @ random)) over all passages."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)
    n = bench.size
    cols = [f"z{i}" for i in range(RANK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        df, z, passages = np.zeros(n, np.int64), np.zeros((n, RANK), np.float32), 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                h, first = _words(c)
                if not len(h):
                    continue
                f = bench.features(h)
                block, _, base = _blocks(first)
                # passages without overlap: two blocks each
                size = np.diff(base)
                start = np.concatenate([[0], np.cumsum(-(-size // 2))])
                text = np.repeat(np.arange(len(size)), np.diff(first))
                passage = start[text] + (block - base[text]) // 2
                total = int(start[-1])
                passages += total
                order = np.argsort(f, kind="stable")
                g, of = f[order].astype(np.int64), passage[order]
                cut = _starts(g)
                new = np.ones(len(g), np.int64)
                new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
                seen = np.add.reduceat(new, cut)
                df[g[cut]] += seen
                damp = np.zeros(n, np.float32)
                damp[g[cut]] = np.where(seen > FREQUENT * total + OFTEN, 0.0, np.log((1.0 + total) / seen))
                y = np.add.reduceat(bench.random[f] * damp[f][:, None], _starts(passage), axis=0)
                z[g[cut]] += np.add.reduceat(y[of], cut, axis=0) * damp[g[cut]][:, None]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([passages], pa.int64())] + [pa.array([0.0], pa.float32())] * RANK, ["f", "df", *cols])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])] + [pa.array(np.ascontiguousarray(z[seen, i])) for i in range(RANK)], ["f", "df", *cols])

    rows = docs.select("text").mapInArrow(released(run), "f int, df long, " + ", ".join(f"{c} float" for c in cols))
    got = rows.groupBy("f").agg(F.sum("df").alias("df"), *(F.sum(c).alias(c) for c in cols)).toArrow()
    f, d = got["f"].to_numpy(), got["df"].to_numpy()
    df, z = np.zeros(n), np.zeros((n, RANK))
    own = f >= 0
    df[f[own]] = d[own]
    z[f[own]] = np.stack([got[c].to_numpy() for c in cols], 1)[own]
    return int(d[~own].sum()), df, z


def _candidates(bench: Benchmark, f: np.ndarray, block: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first block of a passage, part, similarity) where the similarity is CONTAINED or more."""
    every = len(text_of)
    cut = np.searchsorted(block, np.arange(every + 1))  # first word of each block
    vectors = np.add.reduceat(bench.basis[f], cut[:-1], axis=0)
    hit = np.flatnonzero(f < bench.own)
    wide = max(1, CELLS // len(bench.parts))
    for lo in range(0, every, wide):
        hi = min(lo + wide + 1, every)  # a passage needs the next block too
        a, b = np.searchsorted(hit, (cut[lo], cut[hi]))
        word, of = f[hit[a:b]].astype(np.int64), block[hit[a:b]] - lo
        n = bench.first[word + 1] - bench.first[word]
        at = np.repeat(bench.first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        share = np.bincount(np.repeat(of, n) * len(bench.parts) + bench.part[at], bench.weight[at], (hi - lo) * len(bench.parts)).reshape(hi - lo, -1).astype(np.float32)
        # a passage: a block and the next one of its text
        nxt = np.flatnonzero(text_of[lo + 1 : hi] == text_of[lo : hi - 1])
        both, mine = share.copy(), vectors[lo:hi].copy()
        both[nxt] += share[nxt + 1]
        mine[nxt] += vectors[lo:hi][nxt + 1]
        size = np.maximum(np.linalg.norm(mine, axis=1), 1e-6)
        near = (mine / size[:, None]) @ bench.latent
        p, part = np.nonzero(near >= NEAR)
        both[p, part] += bench.share * near[p, part] * size[p] / bench.size_latent[part]
        for p, part in zip(*np.nonzero(both[: min(wide, every - lo)] >= CONTAINED), strict=True):
            yield lo + int(p), int(part), float(both[p, part])


def _search(bench: Benchmark, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, lcs_ratio, answer_ratio) of the best passage of each candidate pair."""
    if not len(h):
        return []
    f = bench.features(h)
    block, text_of, _ = _blocks(first)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    checked: dict[tuple[int, int], tuple[float, float]] = {}  # by first word of the passage and item
    for i, part, similarity in _candidates(bench, f, block, text_of):
        item, text = bench.of_item[part], int(text_of[i])
        lo = int(np.searchsorted(block, i))
        hi = min(lo + 2 * BLOCK, int(first[text + 1]))
        words, tf = np.unique(f[lo:hi][f[lo:hi] < bench.own], return_counts=True)
        size = float(np.sqrt(((tf * bench.idf[words]) ** 2).sum()))
        cosine = min(1.0, similarity * float(bench.norm[part]) / max(size, 1e-12))
        if cosine < COSINE:
            continue
        if (lo, item) not in checked:
            words = bench.items[item]
            grow = len(words)
            near = h[max(int(first[text]), lo - grow) : min(hi + grow, int(first[text + 1]))]
            checked[lo, item] = lcs(words, near) / len(words), float(np.isin(bench.answers[item], near).mean())
        ratio, answer = checked[lo, item]
        key = (text, item)
        found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (ratio, answer, cosine))
    return [(t, i, cosine, ratio, answer) for (t, i), (ratio, answer, cosine) in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs id_col, item_id, cosine, lcs_ratio, answer_ratio: texts that contain a benchmark item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"a benchmark of {size} bytes; give it in parts of at most {MAX_ITEM_BYTES}")
    items = benchmark.select("item_id", "text").orderBy("item_id").toArrow()
    bench = Benchmark(items["item_id"].to_pylist(), items["text"].to_pylist())
    kinds = [docs.schema["id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs_ratio double, answer_ratio double"
    if not bench.ids:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    bench.fit(*_sketch(docs, bench))
    shared = spark.sparkContext.broadcast(bench)
    item_type = items.schema.field("item_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for c in chunks(batch.column(1), 1 << 18):
                rows = [r for r in _search(bench, *_words(c)) if r[3] >= EXACT or r[3] >= PARAPHRASE and r[4] >= ANSWER]
                if rows:
                    text, item, *rest = map(list, zip(*rows, strict=True))
                    ids = batch.column(0).slice(c.lo, c.hi - c.lo).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([bench.ids[i] for i in item], item_type), *(pa.array(x, pa.float64()) for x in rest)], ["id", "item_id", "cosine", "lcs_ratio", "answer_ratio"])

    return docs.mapInArrow(released(run), schema).withColumnRenamed("id", id_col)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go."""
    small_batches(spark)
    rows, row = numbered(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), row)
    return without_rows(rows, row, found.select(row))
