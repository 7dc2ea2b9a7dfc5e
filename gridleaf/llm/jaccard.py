"""Operator 9: n-gram Jaccard self-join by MinHash banding.

Bands and rows are chosen for a target recall at the threshold. A first pass gives every
document a digest of its set of n-grams (five words) and its band hashes. Documents with
equal sets are copies: one representative goes on. Band hashes are shuffled, pre-aggregated
to the least document of each bucket, and joined back to star edges, never to pairs.
Components of stars are the units of verification: their sets are put in bins by size, as
similar sets are of like size, and a bin of more than BLOCK is cut into blocks. Blocks of a bin
and of the next one meet two by two, so every pair of different sets that can be similar is
compared exactly on its full n-gram set, by counts of common grams in numpy.
A block returns, for each document, its number of links and a forest of its links; no pair
becomes a row. Components of the forests are the classes.

Words are ``[^\\x20\\x09-\\x0D]+`` unchanged. A text of one to four words has its word
sequence as its only gram; texts without a word have no gram and link to nothing.
n_links counts the other documents of similarity THRESHOLD or more (copies included),
n_text_links only different sets. Null text counts as empty. Rows with a null id form
classes of their own with a null class_id and no links. Rows that repeat an id and a
text count as one document and each give a row. Ids are taken to name one text; where two
texts share an id, both sets are compared under that id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, chunks, connected, hot_join, least_id, maybe_broadcast, mix, numbered, released, saved, signed, small_batches, span_hash, split_words, splitmix, table, without_rows, word_hashes

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 256


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose recall at the threshold is met within hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = int(np.ceil(log(1 - recall) / log1p(-p))) if p < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def gram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct gram hashes of each text in order, first gram of each text)."""
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), grams)
    cum = np.concatenate([[0], np.cumsum(grams)])
    start = first[text] + np.arange(cum[-1]) - cum[text]
    g = span_hash(h, start, np.minimum(start + n, first[text + 1])) if len(h) else np.zeros(0, np.uint64)
    order = np.lexsort((g, text))
    g = g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[new], np.concatenate([[0], np.cumsum(new)])[cum]


class Signer:
    """MinHash signatures and band hashes of gram sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = splitmix(2 * bands * rows, 99)
        self.a, self.b = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]

    def band_hashes(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[texts with a gram, bands]; first has no empty text."""
        texts = len(first) - 1
        out = np.empty((texts, self.bands), np.uint64)
        if not texts:
            return out
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                acc = np.zeros(texts, np.uint64)
                for r in range(band * self.rows, (band + 1) * self.rows):
                    v = grams * self.a[r] + self.b[r]
                    v ^= v >> np.uint64(32)
                    least = np.minimum.reduceat(v, first[:-1])
                    acc = mix(acc * np.uint64(31) + least)
                out[:, band] = acc
        return out


def _grams_of(c, n: int) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(c)
    return gram_hashes(word_hashes(c, words), words.first, n)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, set_a, set_b, grams, band hashes) of each row of docs (id, text)."""
    signer = Signer(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), 1 << 19):
                g, first = _grams_of(c, n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                marks = signer.band_hashes(g, np.append(first[:-1][full], len(g)))
                sets = np.zeros((2, len(size)), np.uint64)
                with np.errstate(over="ignore"):
                    for k, v in enumerate((g, mix(g ^ np.uint64(0x1234567)))):
                        if len(full):
                            sets[k, full] = mix(np.add.reduceat(mix(v), first[:-1][full]))
                cuts = np.zeros(len(size) + 1, np.int32)
                cuts[1:] = np.cumsum((size > 0) * bands)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(marks.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(signed(sets[0])), pa.array(signed(sets[1])), pa.array(size.astype(np.int64)), lists], ["id", "set_a", "set_b", "grams", "marks"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(released(run), f"id {kind}, set_a long, set_b long, grams long, marks array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """[i, j] sizes of the intersections of the sets, exact, by blocks of the grams that two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    place = np.cumsum(n > 1) - 1
    rows, cols = owner[keep], place[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    wide = 8192
    for lo in range(0, int(n.size and (n > 1).sum()), wide):
        a, b = np.searchsorted(cols, (lo, lo + wide))
        x = np.zeros((len(sets), wide), np.float32)
        x[rows[a:b], cols[a:b] - lo] = 1
        out += x @ x.T
    return out


def _verify(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float) -> pd.DataFrame:
    """Links of one block (all sides 0) or between two blocks (sides 0 and 1): (id, links, texts, to)."""
    size = np.array([len(s) for s in sets], np.float64)
    both = _common(sets).astype(np.float64)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    forest, edges = _Forest(len(ids)), {}
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        if forest.join(i, j):
            edges.setdefault(int(i), []).append(int(ids[j]))
    return pd.DataFrame({"id": ids, "links": linked @ copies, "texts": linked.sum(1), "to": [edges.get(i, []) for i in range(len(ids))]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id_col (an integer), class_id, n_links, n_text_links, class_size."""
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = saved(signatures(texts, n, bands, rows), "marks")
    members = marks.where("id is not null and grams > 0").select("id", "set_a", "set_b").distinct()
    # copies of one set: the least id stands for all
    reps = saved(members.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    mine = marks.alias("m").join(reps.alias("r"), (F.col("m.set_a") == F.col("r.set_a")) & (F.col("m.set_b") == F.col("r.set_b")) & (F.col("m.id") == F.col("r.rep")))
    each = saved(mine.select("rep", F.posexplode("marks").alias("band", "mark")), "bands")
    buckets = each.groupBy("band", "mark").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = each.join(buckets, ["band", "mark"]).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    comps = connected(stars, "candidates")
    comps = comps.union(comps.select(F.col("root").alias("node"), "root").distinct())
    grams = mine.select(F.col("rep").alias("node"), "grams")
    placed = saved(_placed(saved(comps.join(grams, "node"), "sized"), threshold, block), "placed")
    links = saved(_links(texts, placed, reps, n, threshold), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    forest = links.select(F.col("id").alias("a"), F.explode("to").alias("b"))
    classes = saved(connected(forest, "classes").withColumnRenamed("root", "class_root"), "class")
    out = reps.join(counts, reps["rep"] == counts["id"], "left").drop("id").join(classes, F.col("rep") == F.col("node"), "left")
    out = out.select("set_a", "set_b", F.coalesce("class_root", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts"))
    sized = out.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    out = saved(out.join(sized, "class_id"), "sets")
    total = members.count()
    hot = saved(reps.where(F.col("copies") * HOT_SHARE > total).select("set_a", "set_b"), "hot")
    found = hot_join(marks.where("id is not null and grams > 0").select("id", "set_a", "set_b"), out, ["set_a", "set_b"], hot)
    found = found.select("id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"), "class_size")
    alone = marks.where("id is null or grams = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone).withColumnRenamed("id", id_col)


def _placed(comps: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, root, bin, block, with) from (node, root, grams): where each set stands, and the (bin, blocks) it is compared with.

    Bins are powers of 1 / threshold of the set size: similar sets are in one bin or in two that
    follow each other, so no others meet. A bin of more than `block` sets is cut by hash.
    """
    bins = comps.withColumn("bin", F.floor(F.log(F.col("grams").cast("double")) / F.lit(-log(threshold) * (1 + 1e-9))).cast("int"))
    sizes = saved(bins.groupBy("root", "bin").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")), "bins")
    hot = saved(sizes.where(F.col("n") * HOT_SHARE > comps.count()).select("root", "bin"), "hot")
    # each bin also to the neighbours that meet it: at most three rows a bin
    seen = sizes.select("root", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.struct(F.col("bin"), "blocks").alias("other"))
    seen = saved(seen.groupBy("root", "bin").agg(F.collect_list("other").alias("with")), "meets")
    rows = hot_join(bins, seen, ["root", "bin"], hot)
    own = F.filter("with", lambda x: x["bin"] == F.col("bin"))[0]["blocks"]
    return rows.select(F.col("node").alias("rep"), "root", "bin", F.pmod(F.xxhash64("node"), own).cast("int").alias("block"), "with")


def _links(texts: DataFrame, placed: DataFrame, reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, links, texts, to) of every representative for every block it is compared in."""

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                g, first = _grams_of(c, n)
                raw = g.tobytes()
                sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), sets], ["id", "grams"])

    wanted = maybe_broadcast(placed.select("rep"))
    sets = texts.join(wanted, F.col("id") == F.col("rep"), "left_semi").mapInArrow(released(gram_sets), "id long, grams binary")
    copies = reps.select(F.col("rep").alias("of"), "copies").groupBy("of").agg(F.sum("copies").alias("copies"))
    rows = placed.join(copies, F.col("rep") == F.col("of")).join(sets, F.col("rep") == F.col("id")).select("id", "root", "bin", "block", "with", "copies", "grams")
    # a task is a pair of places (bin, block): each with itself and with every one that it meets, once
    me = F.struct("bin", "block")
    others = F.flatten(F.transform("with", lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: F.struct(x["bin"].alias("bin"), k.cast("int").alias("block")))))
    rows = rows.withColumn("other", F.explode(others)).select("id", "root", F.least(me, "other").alias("i"), F.greatest(me, "other").alias("j"), "copies", "grams", (me == F.greatest(me, "other")).alias("right"))

    def verify(batch: pa.Table) -> pa.Table:
        ids = batch["id"].to_numpy()
        i, j = batch["i"][0].as_py(), batch["j"][0].as_py()
        right = batch["right"].to_numpy(zero_copy_only=False)
        side = right.astype(np.int8) if i != j else np.zeros(len(ids), np.int8)
        sets = [np.frombuffer(x, np.uint64) for x in batch["grams"].to_pylist()]
        got = _verify(ids, side, batch["copies"].to_numpy(), sets, threshold)
        return pa.Table.from_pydict({"id": pa.array(got["id"], pa.int64()), "links": pa.array(got["links"], pa.int64()), "texts": pa.array(got["texts"], pa.int64()), "to": pa.array(got["to"], pa.list_(pa.int64()))})

    return rows.groupBy("root", "i", "j").applyInArrow(verify, "id long, links long, texts long, to array<long>")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, of the least doc_id (null after all others)."""
    small_batches(spark)
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("row"), "text"), "row").where("class_size > 1").select("row", "class_id")
    found = saved(found.join(rows.select(F.col(row).alias("of"), least_id("doc_id", row).alias("key")), F.col("row") == F.col("of")).select("row", "class_id", "key"), "classed")
    stay = found.groupBy("class_id").agg(F.min("key").alias("key")).select(F.col("key.row").alias("stays"))
    return without_rows(rows, row, found.select("row").join(stay, F.col("row") == F.col("stays"), "left_anti"))
