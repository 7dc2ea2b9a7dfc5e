"""What the operators of this subpackage share: shared-folder tables, size-checked
joins, and vectorised tokenising of Arrow text batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the
class ``[^\\x20\\x09-\\x0D]`` of every contract here; in UTF-8 no other character
contains those bytes, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an id list that may be broadcast (8 to 24 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows of text in one Arrow batch; bounds what a Python worker holds.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of text that cross to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="gridleaf-"))
    return _own_root[0]


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and malloc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """give_back() for the driver, its JVM included.

    Compiling the code of many plans leaves hundreds of MB that malloc has free and keeps: they add
    up over a session's queries. A JVM without the command System.trim_native_heap keeps them.
    """
    give_back()
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    with contextlib.suppress(Py4JError):
        # through the interface, as the server's own class is not accessible
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it again.

    A lost executor then costs a reread and nothing is computed twice. The folder
    goes when the driver's JVM ends. The driver's freed memory goes back (see give_back_driver).
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back_driver(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast only if its counted rows are within limit; else leave a shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df.hint("merge")


#: A key on more than one in HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are: their part of a table may be broadcast.
HOT_SHARE = 2000


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows and the row of table for their keys; keys in hot, HOT_SHARE at most, meet by broadcast and leave no large task.

    rows and table are read twice, so both should be saved tables.
    """
    hot = F.broadcast(hot.select(*keys))
    few = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, saved, with a number of its own for each row in front, and that column's name: ids may repeat or be null.

    The table is written before it is read again, so a number never changes with a retry.
    """
    row = "__row"
    while row in [c.lower() for c in docs.columns]:
        row += "_"
    return saved(docs.select(F.monotonically_increasing_id().alias(row), *(F.col(f"`{c}`") for c in docs.columns)), "numbered"), row


def without_rows(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """A numbered() table less the rows whose number is in gone (one column), without the numbers."""
    gone = saved(gone.select(F.col(gone.columns[0]).alias("__gone")).distinct(), "drop")
    kept = rows.join(maybe_broadcast(gone), rows[row] == gone["__gone"], "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in rows.columns if c != row))


def least_id(id_col: str, row: str) -> F.Column:
    """What decides which of several rows stays: the least id, null after all others, then the row's number."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))


def least_hashed(rows: DataFrame, order: str, k: int, count: int) -> DataFrame:
    """The rows among which the k of least order lie: order is a 64-bit hash of an id, count the rows of the table.

    A cut on the hash leaves about 1.5 k rows at any size of the table, so that no task merges
    the least rows of all others.
    """
    if count <= 2 * k + 200:
        return rows
    cut = -(1 << 63) + int((1 << 64) * (1.5 * k + 200) / count)
    return rows.where(F.col(order) <= F.lit(cut))


def released(run):
    """run for mapInArrow; the worker gives its freed memory back when the task ends, as workers are kept."""

    def with_release(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_release


# ---------------------------------------------------------------- hashing

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


def splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_pow[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_B, _BI)):
            base = np.full(m, b, np.uint64)
            base[0] = 1
            _pow[k] = np.multiply.accumulate(base)
    return _pow[0][:n], _pow[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = splitmix(256, 7) | np.uint64(1)
_BYTES_LOWER = _BYTES[_LOWER]
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], by one prefix sum over all of them.

    Spans of some dozens of hashed values only: over 1,000 values in certain orders collide.
    """
    with np.errstate(over="ignore"):
        pw, inv = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pw[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * inv[starts])


# ---------------------------------------------------------------- batches


class Chunk(NamedTuple):
    """Some whole documents of a batch, their bytes end to end."""

    lo: int  # first row in the batch
    hi: int
    buf: np.ndarray  # uint8
    offs: np.ndarray  # hi - lo + 1 offsets into buf


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    first: np.ndarray  # document i has the words first[i]:first[i + 1]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents in runs of about limit bytes; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def split_words(chunk: Chunk, inside: np.ndarray | None = None) -> Words:
    """Words of each document; inside marks the bytes of words where white space does not part them."""
    buf, offs = chunk.buf, chunk.offs
    n = len(buf)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(offs), np.int64))
    inside = ~WS[buf] if inside is None else inside
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    at = offs[offs < n]
    begins[at] = inside[at]
    at = offs[offs > 0] - 1
    lasts[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(lasts) + 1
    return Words(start, end, np.searchsorted(start, offs))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def lane_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each buf[start:end] of bytes: each eight bytes are mixed with their place, the sum with the length.

    Spans of up to eight bytes and one length never collide; longer ones do only by chance.
    """
    size = end - start
    lanes = np.maximum((size + 7) >> 3, 1)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    first = np.cumsum(lanes) - lanes
    one = len(lanes) == 0 or int(lanes.max()) == 1
    place = np.zeros(len(start), np.int64) if one else np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    at = start if one else np.repeat(start, lanes) + 8 * place
    left = (size if one else np.repeat(size, lanes)) - 8 * place
    with np.errstate(over="ignore"):
        value = words[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(np.maximum(left, 0), 8).astype(np.uint64) * np.uint64(8)) % np.uint64(64))
        value[left <= 0] = 0
        value = mix(mix(value ^ np.uint64(seed)) + (place + 1).astype(np.uint64) * _STEP)
        if not one:
            value = np.add.reduceat(value, first)
        return mix(value + size.astype(np.uint64) * _C2)


def word_hashes(chunk: Chunk, words: Words, lower: bool = False) -> np.ndarray:
    return lane_hash(_LOWER[chunk.buf] if lower else chunk.buf, words.start, words.end)


def hash_word(word: str | bytes, lower: bool = False) -> int:
    """The hash that word_hashes gives this word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(lane_hash(_LOWER[raw] if lower else raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (1 each by default)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


class Slots:
    """Places of 64-bit keys: a table by bits of their product, and sorted keys whose slot another one took."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 1))
        slot, every = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        self.place = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.place[slot] = every
        rest = np.flatnonzero(self.place[slot] != every)
        self.rest = rest[np.argsort(keys[rest])]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = self.place[self._slot(keys)].astype(np.int64)
        taken = np.flatnonzero(out >= 0)
        other = taken[self.keys[out[taken]] != keys[taken]]  # a key outside the table leaves its slot to others
        at = lookup(self.keys[self.rest], keys[other])
        out[other] = np.where(at >= 0, self.rest[at], -1) if len(self.rest) else -1
        return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m) of edges (a, b): m is the least b of each a. Hubs, of which there are HOT_SHARE at most, meet theirs by broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") * HOT_SHARE > total
    hubs = F.broadcast(least.where(hub).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    known = edges.join(hubs, edges["a"] == F.col("hub"), "left")
    rest = known.where("hub is null").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    return known.where("hub is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the least node.

    Alternating large-star and small-star rounds; each round is written to the shared
    folder, and rounds stop when no edge changes. A star's centre may hold a third of
    all nodes: both steps are joins and sums over (node, neighbour) rows, never lists, and
    hubs meet their sums by broadcast (see _with_least).
    """
    cur = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    last = (cur.count(), None)
    while True:
        # large star: each larger neighbour of u links to the least of u and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * last[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = saved(large.distinct(), name)
        # small star: u and its smaller neighbours link to the least of them
        small = _with_least(large, last[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        cur = saved(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
