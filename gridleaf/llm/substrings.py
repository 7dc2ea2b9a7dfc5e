"""Operator 4: substring deduplication by de Bruijn compaction.

Windows of WINDOW words are the edges of a de Bruijn graph between their first and last
WINDOW - 1 words. Edges are dealt out by their minimiser, the least hash of the K-word
spans inside them; consecutive edges of one document with one minimiser form a path piece.
1. Minimisers that occur in one document only can't hold a repeated edge; they go.
2. Equal pieces (same edges in the same order: repeated paths without a branch) compact
   to one row with the least document that has them, before anything is exploded.
3. Edges of the compacted pieces meet by (minimiser, edge hash) in a Spark join that yields
   each edge's least document: branches are where pieces of one minimiser differ.
4. Each source piece looks up its edges' least documents and the word offsets there; edges
   whose least document is smaller become spans to remove. Spans of one document that go on
   in one source compact into one.
5. Source coordinates verify every span: the words at the span and those at its source are
   read again, and a span stays only where their bytes have one 128-bit digest.

All windows of the input are judged, whole texts, with no cap. Words are unchanged.

Defined cases: null text has no words, keeps none, and hashes the empty string; documents
of fewer than WINDOW words lose nothing; a passage repeated inside one document only is
kept; rows that share an id are one source, so neither removes from the other, and each
row gives a row (spans of either apply to both by offset). Rows with a null id lose
nothing and take nothing from others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_SHARE, chunks, hot_join, maybe_broadcast, powers, released, saved, signed, small_batches, span_hash, split_words, table, word_hashes

WINDOW = 50
K = 20


def _pieces(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Path pieces of each text: (text, first edge, edges, minimiser hash); edges are word offsets in the chunk."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(h)
    if n < window:
        return none
    at = np.arange(n - k + 1)
    grams = span_hash(h, at, at + k)
    w = window - k + 1
    best, arg, span = grams, at, 1  # least gram of span grams from each place, the leftmost on ties
    while span < w:
        step = min(span, w - span)
        right = best[step:]
        take = right < best[: len(right)]
        arg = np.where(take, arg[step:], arg[: len(right)])
        best = np.where(take, right, best[: len(right)])
        span += step
    edges = n - window + 1
    arg = arg[:edges]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:edges]
    ok = np.arange(edges) + window <= first[text + 1]
    cut = np.ones(edges, bool)
    cut[1:] = (arg[1:] != arg[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, edges))
    keep = ok[start]
    start, length = start[keep], length[keep]
    return text[start], start, length, grams[arg[start]]


def _edge_hashes(h: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window that starts at start, independent of the minimisers' hashes."""
    with np.errstate(over="ignore"):
        other = (h ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
        other ^= other >> np.uint64(31)
    powers(len(h) + 1)
    return span_hash(other, start, start + window)


def _prepare(c) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(c)
    return word_hashes(c, words), words.first


def path_pieces(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, seed, start, n) of every path piece of every document; start counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                h, first = _prepare(c)
                text, start, n, seed = _pieces(h, first, window, k)
                ids = batch.column(0).slice(c.lo, c.hi - c.lo).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(seed)), pa.array((start - first[text]).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "seed", "start", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(released(run), f"id {kind}, seed long, start int, n int")


def _ranges(starts_and_ends: list) -> bytes:
    """Merged half-open ranges as int32 pairs."""
    out: list[list[int]] = []
    for a, b in sorted(starts_and_ends):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int32).tobytes()


def _by_document(rows: DataFrame) -> DataFrame:
    """(id, ranges) from rows (id, a, b) of which one document has no more than words."""
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_ranges([(e["a"], e["b"]) for e in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "ranges"])

    kind = rows.schema["id"].dataType.simpleString()
    return lists.mapInArrow(released(run), f"id {kind}, ranges binary")


def _joined_spans(rows: DataFrame) -> DataFrame:
    """(id, a, b, src, src_a) with the spans of one document that go on in one source joined; no document has more than words."""
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("src", (F.col("src_a") - F.col("a")).alias("shift"), "a", "b")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                last = None
                for e in sorted(x, key=lambda e: (e["src"], e["shift"], e["a"])):
                    if last is not None and last[0] == e["src"] and last[1] == e["shift"] and e["a"] <= last[3]:
                        last[3] = max(last[3], e["b"])
                        continue
                    last = [e["src"], e["shift"], e["a"], e["b"]]
                    at.append(i)
                    out.append(last)
            src, shift, a, b = (list(k) for k in zip(*out, strict=True)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(src, batch.column(0).type), pa.array([x + y for x, y in zip(shift, a, strict=True)], pa.int32())],
                ["id", "a", "b", "src", "src_a"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return lists.mapInArrow(released(run), f"id {kind}, a int, b int, src {kind}, src_a int")


def _verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (id, a, b) of spans whose words are those at their source, by a digest of the words' bytes."""
    kind = spans.schema["id"].dataType.simpleString()
    end = (F.col("src_a") + F.col("b") - F.col("a")).alias("b")
    asked = spans.select("id", "a", "b").unionByName(spans.select(F.col("src").alias("id"), F.col("src_a").alias("a"), end)).distinct()
    lists = asked.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.array([(e["a"], e["b"]) for e in x], np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "ranges"])

    asked = saved(lists.mapInArrow(released(pack), f"id {kind}, ranges binary"), "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cuts, digests = [], [], []
            for i, (text, r) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                for a, b in np.frombuffer(r, np.int32).reshape(-1, 2).tolist():
                    at.append(i)
                    cuts.append((a, b))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words[a:b])) if b <= len(words) else b"")
            a, b = (list(k) for k in zip(*cuts, strict=True)) if cuts else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(digests, pa.binary())], ["id", "a", "b", "digest"])

    # rows that share an id are one source: a span of it is any of their texts' words
    seen = saved(_with_ranges(docs, asked, "inner").mapInArrow(released(read), f"id {kind}, a int, b int, digest binary").where("octet_length(digest) > 0").distinct(), "seen")
    there = seen.select(F.col("id").alias("src"), F.col("a").alias("src_a"), (F.col("b") - F.col("a")).alias("n"), F.col("digest").alias("there"))
    mine = saved(spans.withColumn("n", F.col("b") - F.col("a")).join(seen, ["id", "a", "b"]), "mine")
    place = ["src", "src_a", "n"]  # a third of all spans may have one source
    hot = saved(mine.groupBy(*place).count().where(F.col("count") * HOT_SHARE > mine.count()), "hot")
    return hot_join(mine, there, place, hot).where("digest = there").select("id", "a", "b")


def _with_ranges(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """docs and the ranges of their id; ranges is broadcast only if its size is within bounds."""
    size = ranges.agg(F.count("*"), F.sum(F.octet_length("ranges"))).first()
    rows = size[0] if (size[1] or 0) <= 16 * BROADCAST_ROWS else BROADCAST_ROWS + 1
    return docs.join(maybe_broadcast(ranges.withColumnRenamed("id", "of"), rows), F.col("id") == F.col("of"), how).select("id", "text", "ranges")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, ranges): words covered by a window that a smaller id has too, as int32 pairs of word offsets."""
    kind = docs.schema["id"].dataType.simpleString()
    pieces = saved(path_pieces(docs.where("id is not null"), window, k), "pieces")
    shared = saved(pieces.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("seed"), "shared")
    # written first, so that beyond the broadcast bound both sides are plain exchanges, which AQE splits at a hot minimiser
    places = pieces.join(maybe_broadcast(shared), "seed").select("id", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    ranges = saved(_by_document(places), "places")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for c in chunks(batch.column(1)):
                h, first = _prepare(c)
                text, start, n, seed = _pieces(h, first, window, k)
                keep = np.zeros(len(h) + 1, np.int64)
                for i in range(c.hi - c.lo):
                    r = np.frombuffer(lists[c.lo + i].as_py(), np.int32).reshape(-1, 2) + first[i]
                    np.add.at(keep, r[:, 0], 1)
                    np.add.at(keep, np.minimum(r[:, 1], len(h)), -1)
                keep = np.cumsum(keep)[start] > 0
                text, start, n, seed = text[keep], start[keep], n[keep], seed[keep]
                all_edges = _edge_hashes(h, np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), window)
                cuts = np.concatenate([[0], np.cumsum(n)]) * 8
                packed = all_edges.tobytes()
                ids = batch.column(0).slice(c.lo, c.hi - c.lo).take(pa.array(text))
                path = pa.array([packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(seed)), pa.array((start - first[text]).astype(np.int32)), path], ["id", "seed", "start", "path"])

    found = _with_ranges(docs, ranges, "inner").mapInArrow(released(edges), f"id {kind}, seed long, start int, path binary")
    # a path is compared in full where paths compact, and goes on as its 128-bit name
    found = found.withColumn("p1", F.xxhash64("path")).withColumn("p2", F.xxhash64(F.lit(1), "path"))
    found = saved(found.withColumn("n", (F.octet_length("path") / 8).cast("int")), "edges")
    name = ["seed", "p1", "p2"]
    # repeated paths without a branch: one row each
    paths = saved(found.groupBy(*name, "path").agg(F.min(F.struct("id", "start")).alias("lo"), F.count("*").alias("copies")).select(*name, "path", "copies", F.col("lo.id").alias("lo"), F.col("lo.start").alias("lo_a")), "paths")
    each = _explode_edges(paths)
    least = each.groupBy("seed", "edge").agg(F.min(F.struct("lo", "lo_a")).alias("m"))
    less = F.struct("at", F.col("m.lo").alias("m"), F.col("m.lo_a").alias("m_a"))
    branched = each.join(least, ["seed", "edge"]).where("m.lo < lo").groupBy(*name).agg(F.collect_list(less).alias("less"))
    firsts = saved(paths.select(*name, "lo", "lo_a").join(branched, name, "left"), "firsts")
    hot = saved(paths.where(F.col("copies") * HOT_SHARE > found.count()).select(*name).distinct(), "hot")
    sources = hot_join(found.select("id", "start", "n", *name), firsts, name, hot)
    # an edge goes where its least document is smaller than the source
    whole = sources.where("lo < id").select("id", F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"), F.col("lo").alias("src"), F.col("lo_a").alias("src_a"))
    some = sources.where("lo = id and less is not null").select("id", "start", F.explode("less").alias("e")).where("e.m < id")
    some = some.select("id", (F.col("start") + F.col("e.at")).alias("a"), (F.col("start") + F.col("e.at") + window).alias("b"), F.col("e.m").alias("src"), F.col("e.m_a").alias("src_a"))
    spans = saved(_joined_spans(whole.unionByName(some)), "spans")
    return saved(_by_document(_verified(docs.where("id is not null"), spans)), "verified")


def _explode_edges(paths: DataFrame) -> DataFrame:
    """(seed, p1, p2, at, edge, lo, lo_a) of every edge of the compacted paths: its least document and the word offset there."""
    names = ["seed", "p1", "p2", "at", "edge", "lo", "lo_a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw = part.column("path").to_pylist()
                n = np.array([len(x) // 8 for x in raw], np.int64)
                row = np.repeat(np.arange(len(raw)), n)
                at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                edge = np.frombuffer(b"".join(raw), np.int64)
                there = part.column("lo_a").to_numpy()[row] + at
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in ("seed", "p1", "p2")), pa.array(at), pa.array(edge), part.column("lo").take(pa.array(row)), pa.array(there.astype(np.int32))], names)

    kind = paths.schema["lo"].dataType.simpleString()
    return paths.mapInArrow(released(run), f"seed long, p1 long, p2 long, at int, edge long, lo {kind}, lo_a int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_text (kept words joined by one space)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, window, k)
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n, gone, kept = [], [], []
            for text, r in zip(texts, ranges, strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if r:
                    left = []
                    at = 0
                    for a, b in np.frombuffer(r, np.int32).reshape(-1, 2).tolist():
                        left += words[at:a]
                        at = min(b, len(words))
                    words = left + words[at:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return _with_ranges(docs, spans, "left").mapInArrow(released(cut), f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract by a dictionary of all windows: (n_words, n_removed, kept_sha256) of each id."""
    least: dict[tuple, int] = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in sorted(words.items()):
        for p in range(len(w) - window + 1):
            least.setdefault(tuple(w[p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    return out
