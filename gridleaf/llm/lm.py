"""Operator 10: language-model scores by a weighted backoff automaton.

States are the empty history and every word; arcs are all word pairs seen LEAST times or
more in training. An arc v -> w has the probability (n - DISCOUNT + back(v) U(w)) / (c(v) + PRIOR),
U being the base's unigram probability, and a state's failure arc to the empty history
weighs back(v) / (c(v) + PRIOR), where back(v) = PRIOR + c(v) - sum of its arcs' (n - DISCOUNT):
the arcs of each state sum to one with what they leave to failure. A text is read once from
left to right: the state is carried, a missing arc follows the failure arc and pays its
weight, and log-probabilities accumulate. All texts of a batch take the step at once on arrays.

The model has no bound on its size: it is a saved table of buckets, each with the sorted arcs
and states that hash to it, packed (see pack). Arcs of a state share its bucket; those of
the SPREAD commonest are dealt over several. Tasks hold the HEAD words and the ARCS commonest arcs.
Texts are walked in batches of BATCH tokens: where the walk meets another word or arc it
takes the failure arc, and asks the arc's bucket once for all texts of the batch; the answers
come back to the batch, which adds the difference. The bounds decide where an answer comes
from, never what it is. Buckets and batches grow in number with the input, not in size.

Tokens: A-Z lower-cased, words, then one end a text. Words are told apart by 64-bit hashes.
Defined cases: a null or empty text is its end alone; with no training text N = V = 0 and every
token has probability 0.5 / 0.5 = 1, its logarithm 0. score_rows() gives a row for every row of
its input, whatever ids repeat or are null; score_texts() adds the rows of one id up, null being
one. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, chunks, counted, lookup, mix, released, saved, signed, small_batches, split_words, table, word_hashes

HEAD = 1 << 19
ARCS = 1 << 20
LEAST = 1
DISCOUNT = 0.5
PRIOR = 1.0
#: Distinct keys that a task gathers before it passes them on to the shuffle.
FLUSH = 1 << 20
#: Tokens that are walked together; a longer text is a batch of its own.
BATCH = 1 << 20
#: Training tokens a bucket of the model stands for.
BUCKET = 1 << 21
#: The arcs of this many commonest states are dealt over CLASSES buckets each; any other state has under N / SPREAD tokens.
SPREAD, CLASSES = 1 << 12, 64
_END = np.uint64(0x1)  # the end token's hash; words have mixed hashes
#: A word's code is its place in the head, or its hash with this bit (a negative number).
_RARE = np.uint64(1 << 63)


def tokens(chunk) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one end a text, first token of each text)."""
    words = split_words(chunk)
    h = word_hashes(chunk, words, lower=True)
    h[h == _END] += np.uint64(1)
    first = words.first + np.arange(len(words.first))
    out = np.empty(int(first[-1]), np.uint64)
    out[first[1:] - 1] = _END
    mask = np.ones(len(out), bool)
    mask[first[1:] - 1] = False
    out[mask] = h
    return out, first


def _gather(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _count_rows(keys_of) -> object:
    """A mapInArrow function that counts keys_of(batch chunk) within a task, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                k, n = counted(keys_of(c))
                parts.append((k, n))
                held += len(k)
                if held > FLUSH:
                    parts = [_gather(parts)]
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield _rows(parts.pop())
                        held = 0
        if parts:
            yield _rows(_gather(parts))

    return run


def _rows(got: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(got[0].astype(np.uint64))), pa.array(got[1].astype(np.int64))], ["key", "n"])


def _counts(texts: DataFrame, keys_of) -> DataFrame:
    return texts.mapInArrow(released(_count_rows(keys_of)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- arcs as arrays

_CODEC = pa.Codec("zstd")


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns in a few bytes a row: the first, which is sorted, by its steps; all byte by byte, compressed."""
    out = [len(columns).to_bytes(8, "little")]
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c, np.int64)
        if not k:
            with np.errstate(over="ignore"):
                c = np.diff(c, prepend=np.int64(0))
        z = _CODEC.compress(c.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)
        out += [len(c).to_bytes(8, "little"), len(z).to_bytes(8, "little"), z]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for k in range(int.from_bytes(data[:8], "little")):
        n, size = (int.from_bytes(data[at + j : at + j + 8], "little") for j in (0, 8))
        raw = np.frombuffer(_CODEC.decompress(data[at + 16 : at + 16 + size], 8 * n, asbytes=True), np.uint8)
        c = np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()
        out.append(np.cumsum(c) if not k else c)
        at += 16 + size
    return out


def _order(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order that brings equal arcs together: by v and w, those of a rare word first."""
    plain = (v >= 0) & (w >= 0)
    a, b = np.flatnonzero(plain), np.flatnonzero(~plain)
    return np.concatenate([b[np.lexsort((w[b], v[b]))], a[np.argsort(v[a] << 32 | w[a])]])


def _starts(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where runs of equal arcs start in ordered arcs."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    return np.flatnonzero(new)


def _runs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct arcs in order, and the sums of n."""
    order = _order(v, w)
    v, w = v[order], w[order]
    at = _starts(v, w)
    return v[at], w[at], np.add.reduceat(n[order], at) if len(at) else n


def _bucket(v: np.ndarray, w: np.ndarray | None, buckets: int) -> np.ndarray:
    """The bucket of each arc: its state's, or for the commonest states one by a class of w. Without w, of words."""
    key = v.view(np.uint64)
    with np.errstate(over="ignore"):
        if w is not None:
            spread = (v >= 0) & (v < SPREAD)
            key = np.where(spread, key * np.uint64(CLASSES) + mix(w.view(np.uint64)) % np.uint64(CLASSES) + np.uint64(1 << 60), key)
        h = mix(key * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _dealt(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its rows) of sorted buckets."""
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(buckets)], strict=False):
        yield int(buckets[a]), slice(a, b)


def _level(n):
    """The bin of a count in the histogram of counts: log2(n) / 64."""
    return np.floor(np.log2(n) * 64).astype(np.int64)


def _cut(levels: list[tuple[int, int]], most: int) -> int | None:
    """The least level above which at most `most` rows lie; None if there is none."""
    held, cut = 0, None
    for level, count in sorted(levels, reverse=True):
        held += count
        if held > most:
            break
        cut = level
    return cut


def _commonest(counts: DataFrame, most: int) -> pa.Table:
    """At most `most` rows of the greatest n: all above a cut, so rows of one n come together.

    The cut comes from a histogram in bins of log2(n) / 64, some thousands of rows at
    any size of the table, so no task merges the top rows of all others.
    """
    level = F.floor(F.log2("n") * 64)
    cut = _cut([(r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()], most)
    return (counts.where(F.lit(False)) if cut is None else counts.where(level >= cut)).toArrow()


def _log_back(c: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """log10 weight of a failure arc."""
    return np.log10((c - kept + PRIOR) / (c + PRIOR))


class Automaton:
    """Head words with their failure weights, and the commonest arcs with what each adds to failing."""

    def __init__(self, head: np.ndarray, head_n: np.ndarray, total: int, distinct: int):
        """head: hashes by falling count; an id is a place in it."""
        self.words = Slots(head)
        self.n = head_n.astype(np.float64)
        self.total, self.distinct = total, distinct
        self.log_total = float(np.log10(total + 0.5 * (distinct + 1)))
        self.uni = np.log10(self.n + 0.5) - self.log_total
        self.kept = np.zeros(len(head))  # of each head word's count, what its arcs hold
        self.fail = np.zeros(len(head))
        self.arcs, self.gain = Slots(np.zeros(0, np.int64)), np.zeros(0)

    def add_states(self, ids: np.ndarray, kept: np.ndarray) -> None:
        self.kept[ids] = kept
        self.fail = _log_back(self.n, self.kept)

    def add_arcs(self, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        self.arcs = Slots(v << 32 | w)
        self.gain = np.log10(1 + (n - DISCOUNT) / ((self.n[v] - self.kept[v] + PRIOR) * 10 ** self.uni[w]))

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Codes of token hashes: places in the head, negative for other words."""
        at = self.words.find(h)
        return np.where(at >= 0, at, signed(h | _RARE))

    def steps(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each token adds, whether its arc has to be asked for); rare words add nothing here."""
        v = np.empty_like(codes)
        v[1:] = codes[:-1]
        start = np.zeros(len(codes), bool)
        start[first[:-1]] = True
        v[start] = -1
        out = np.where(codes >= 0, self.uni[np.maximum(codes, 0)], 0.0) if len(self.n) else np.zeros(len(codes))
        ask = ~start
        state = np.flatnonzero(v >= 0)
        out[state] += self.fail[v[state]]
        both = state[codes[state] >= 0]
        at = self.arcs.find(v[both] << 32 | codes[both])
        both, at = both[at >= 0], at[at >= 0]
        out[both] += self.gain[at]
        ask[both] = False
        return out, ask


class Model(NamedTuple):
    """An automaton, and the saved buckets of what it does not hold."""

    automaton: Automaton
    table: DataFrame  # bucket, arcs (v, w, n), words (code, c, distinct arcs), seen (head word, arcs here), levels (level, arcs)
    buckets: int
    least: int | None  # head arcs of this level or more are in the automaton

    @property
    def arcs(self) -> DataFrame:
        """(v, w, n) of the arcs outside the automaton."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    v, w, n = unpack(data)
                    out = ~_inside(v, w, n, least)
                    yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (v, w, n)], ["v", "w", "n"])

        return self.table.select("arcs").mapInArrow(released(run), "v long, w long, n long")

    @property
    def words(self) -> DataFrame:
        """(code, c, distinct) of the words outside the head: count and number of arcs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(data)], ["code", "c", "distinct"])

        return self.table.select("words").mapInArrow(released(run), "code long, c long, distinct long")


def _inside(v: np.ndarray, w: np.ndarray, n: np.ndarray, least: int | None) -> np.ndarray:
    """The arcs that the automaton holds."""
    if least is None:
        return np.zeros(len(v), bool)
    return (v >= 0) & (w >= 0) & (_level(n) >= least)


def _arc_blobs(texts: DataFrame, shared, buckets: int) -> DataFrame:
    """(bucket, kind 0, blob of v, w, n): the word pairs of a table of one text column, counted within tasks."""

    def deal(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        b = _bucket(v, w, buckets)
        order = np.argsort(b, kind="stable")
        v, w, n, b = v[order], w[order], n[order], b[order]
        got = [(k, pack(v[at], w[at], n[at])) for k, at in _dealt(b)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([0] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = lambda parts: _runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        parts, held = [], 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                h, first = tokens(c)
                codes = shared.value.codes(h)
                inner = np.ones(len(codes), bool)
                inner[first[:-1]] = False
                at = np.flatnonzero(inner)
                parts.append(_runs(codes[at - 1], codes[at], np.ones(len(at), np.int64)))
                held += len(parts[-1][0])
                if held > FLUSH:
                    parts = [merge(parts)]
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield deal(*parts.pop())
                        held = 0
        if parts:
            yield deal(*merge(parts))

    return texts.mapInArrow(released(run), "bucket long, kind int, blob binary")


def _word_blobs(rare: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind 1, blob of code, n) of the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = signed(batch.column(0).to_numpy().view(np.uint64) | _RARE), batch.column(1).to_numpy()
            b = _bucket(code, None, buckets)
            order = np.lexsort((code, b))
            code, n, b = code[order], n[order], b[order]
            got = [(k, pack(code[at], n[at])) for k, at in _dealt(b)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([1] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "kind", "blob"])

    return rare.select("key", "n").mapInArrow(released(run), "bucket long, kind int, blob binary")


def _merged(group: pa.Table) -> pa.Table:
    """One row of the model's table from the blobs of a bucket."""
    parts = ([], [])
    for kind, blob in zip(group["kind"].to_pylist(), group["blob"].to_pylist(), strict=True):
        parts[kind].append(unpack(blob))
    none = np.zeros(0, np.int64)
    v, w, n = _runs(*(np.concatenate(x) for x in zip(*parts[0], strict=True))) if parts[0] else (none, none, none)
    keep = n >= LEAST
    v, w, n = v[keep], w[keep], n[keep]
    code, c = (np.concatenate(x) for x in zip(*parts[1], strict=True)) if parts[1] else (none, none)
    order = np.argsort(code)
    code, c = code[order], c[order]
    states, arcs = counted(v)
    at = lookup(states, code)
    distinct = np.where(at >= 0, arcs[at] if len(arcs) else 0, 0)
    own = states >= 0
    head = (v >= 0) & (w >= 0)
    levels, size = counted(_level(n[head]))
    blobs = [pack(v, w, n), pack(code, c, distinct), pack(states[own], arcs[own]), pack(levels, size)]
    return pa.table([group["bucket"].slice(0, 1), *([x] for x in blobs)], pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("arcs", "words", "seen", "levels"))]))


def _summed(blobs: DataFrame) -> DataFrame:
    """(key, n): sums by key of a column of blobs of (key, n), added up within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            got = [_gather([*got, *(tuple(unpack(x)) for x in batch.column(0).to_pylist())])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got[0]], ["key", "n"])

    return blobs.mapInArrow(released(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, words: DataFrame) -> Model:
    """texts: one column of training texts; words: their counts (key, n), a saved table."""
    spark = texts.sparkSession
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _commonest(words, HEAD)
    keys, n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    model = Automaton(np.ascontiguousarray(keys[order]).view(np.uint64), n[order], int(total), int(distinct))
    shared = spark.sparkContext.broadcast(model)  # HEAD words at most
    buckets = max(1, int(total) // BUCKET)
    rare = words.where(F.col("n") < int(n.min())) if len(n) else words
    blobs = _arc_blobs(texts, shared, buckets).unionByName(_word_blobs(rare, buckets))
    rows = blobs.groupBy("bucket").applyInArrow(_merged, "bucket long, arcs binary, words binary, seen binary, levels binary")
    rows = saved(rows, "model")
    own = _summed(rows.select("seen")).toArrow()  # HEAD rows at most
    ids, arcs = own["key"].to_numpy(), own["n"].to_numpy()
    model.add_states(ids, np.where(arcs > 0, model.n[ids] - DISCOUNT * arcs, 0.0))
    least = _cut([(r["key"], r["n"]) for r in _summed(rows.select("levels")).collect()], ARCS)
    model.add_arcs(*_common_arcs(rows, least))
    return Model(model, rows, buckets, least)


def _common_arcs(rows: DataFrame, least: int | None) -> list[np.ndarray]:
    """v, w and n of the arcs that the automaton holds: ARCS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v, w, n = unpack(data)
                own = _inside(v, w, n, least)
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (v, w, n)], ["v", "w", "n"])

    if least is None:
        return [np.zeros(0, np.int64)] * 3
    got = rows.select("arcs").mapInArrow(released(run), "v long, w long, n long").toArrow()
    return [got[k].to_numpy() for k in ("v", "w", "n")]


# ---------------------------------------------------------------- scores

_SUMS = ("n_tokens", "n_known", "base_score", "score")


class _Walk:
    """Texts of one batch as far as the automaton takes them, and what is asked for."""

    def __init__(self, automaton: Automaton, buckets: int, codes: np.ndarray, first: np.ndarray):
        steps, ask = automaton.steps(codes, first)
        inside = codes >= 0
        base = np.where(inside, automaton.uni[np.maximum(codes, 0)], 0.0) if len(automaton.uni) else np.zeros(len(codes))
        cut = first[:-1]
        self.sums = [np.diff(first), *(np.add.reduceat(x, cut) for x in (inside.astype(np.int64), base, steps))]
        text = np.repeat(np.arange(len(cut)), np.diff(first))
        arc, rare = np.flatnonzero(ask), np.flatnonzero(~inside)
        v, w = codes[arc - 1], codes[arc]
        # distinct arcs and words, by bucket; a token's answer has its place there
        order = _order(v, w)
        at = _starts(v[order], w[order])
        which = np.empty(len(v), np.int64)
        which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v))))
        self.v, self.w = v[order[at]], w[order[at]]
        by, self.arc_bucket = self._by_bucket(_bucket(self.v, self.w, buckets))
        self.v, self.w = self.v[by], self.w[by]
        self.words, word = np.unique(codes[rare], return_inverse=True)
        by_word, self.word_bucket = self._by_bucket(_bucket(self.words, None, buckets))
        self.words = self.words[by_word]
        # places of each text in rising order, as sums do not mind
        self.arc_of, self.word_of = (np.sort(text[x] << 40 | y) & ((1 << 40) - 1) for x, y in ((arc, np.argsort(by)[which]), (rare, np.argsort(by_word)[word])))
        self.arcs_of_text, self.words_of_text = (np.bincount(text[x], minlength=len(cut)) for x in (arc, rare))

    @staticmethod
    def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(buckets, kind="stable")
        return order, buckets[order]

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob of arcs and words); arcs come first."""
        arcs, words = dict(_dealt(self.arc_bucket)), dict(_dealt(self.word_bucket))
        none = slice(0, 0)
        for k in sorted(arcs.keys() | words.keys()):
            a, b = arcs.get(k, none), words.get(k, none)
            yield k, pack(self.v[a], self.w[a]) + pack(self.words[b])

    def blob(self) -> bytes:
        """All that scored() needs beside the answers."""
        with np.errstate(over="ignore"):
            return pack(self.sums[0], self.sums[1], self.arcs_of_text, self.words_of_text, self.sums[2].view(np.int64), self.sums[3].view(np.int64)) + pack(self.arc_of) + pack(self.word_of)


def _several(data: bytes, n: int) -> list[list[np.ndarray]]:
    """The columns of n packs one after the other."""
    out = []
    for _ in range(n):
        out.append(unpack(data))
        at = 8
        for _ in out[-1]:
            at += 16 + int.from_bytes(data[at + 8 : at + 16], "little")
        data = data[at:]
    return out


def _answered(asks: pa.Table, model: pa.Table) -> pa.Table:
    """(batch, bucket, kind 1, blob): counts of the arcs and words that each batch asks one bucket for."""
    none = np.zeros(0, np.int64)
    (v, w, n), (code, c, distinct) = (unpack(model["arcs"][0].as_py()), unpack(model["words"][0].as_py())) if len(model) else ([none] * 3, [none] * 3)
    parts = [_several(blob, 2) for blob in asks["blob"].to_pylist()]
    if not parts:
        return pa.table([asks["batch"], asks["bucket"], pa.array([], pa.int32()), asks["blob"]], ["batch", "bucket", "kind", "blob"])
    counts = _find(v, w, n, *(np.concatenate([p[0][k] for p in parts]) for k in (0, 1)))
    at = lookup(code, np.concatenate([p[1][0] for p in parts]))
    found = [np.where(at >= 0, x[at] if len(x) else 0, 0) for x in (c, distinct)]
    arc, word = (np.cumsum([0] + [len(p[k][0]) for p in parts]) for k in (0, 1))
    blobs = [pack(counts[arc[i] : arc[i + 1]]) + pack(*(x[word[i] : word[i + 1]] for x in found)) for i in range(len(parts))]
    return pa.table([asks["batch"], asks["bucket"], pa.array(np.ones(len(blobs), np.int32)), pa.array(blobs, pa.binary())], ["batch", "bucket", "kind", "blob"])


def _find(v: np.ndarray, w: np.ndarray, n: np.ndarray, av: np.ndarray, aw: np.ndarray) -> np.ndarray:
    """n of each asked arc, 0 where there is none; the model's arcs in the order of _order."""
    out = np.zeros(len(av), np.int64)
    plain, asked = (v >= 0) & (w >= 0), (av >= 0) & (aw >= 0)
    at = lookup(v[plain] << 32 | w[plain], av[asked] << 32 | aw[asked])
    out[asked] = np.where(at >= 0, n[plain][at] if plain.any() else 0, 0)
    if not asked.all() and not plain.all():
        v, w, n, av, aw = v[~plain], w[~plain], n[~plain], av[~asked], aw[~asked]
        both_v, both_w = np.concatenate([v, av]), np.concatenate([w, aw])
        order = np.lexsort((np.arange(len(both_v)) >= len(v), both_w, both_v))  # the model's arc before an asked one
        at = _starts(both_v[order], both_w[order])
        count = np.concatenate([n, np.zeros(len(av), np.int64)])[order]
        got = np.empty(len(both_v), np.int64)
        got[order] = np.repeat(count[at], np.diff(np.append(at, len(order))))
        out[~asked] = got[len(v) :]
    return out


def _scored(automaton: Automaton, rows: pa.Table) -> pa.Table:
    """The rows of one batch: its walk (kind 0), its asks (kind 2) and their answers (kind 1)."""
    kind, bucket, blob = rows["kind"].to_numpy(), rows["bucket"].to_numpy(), rows["blob"].to_pylist()
    order = np.lexsort((bucket, kind))
    (walk,) = (k for k in order if kind[k] == 0)
    (size, known, arcs_of_text, words_of_text, base, score), (arc_of,), (word_of,) = _several(blob[walk], 3)
    base, score = base.view(np.float64).copy(), score.view(np.float64).copy()
    asked = [_several(blob[k], 2) for k in order if kind[k] == 2]
    got = [_several(blob[k], 2) for k in order if kind[k] == 1]
    join = lambda parts, i, j: np.concatenate([p[i][j] for p in parts]) if parts else np.zeros(0, np.int64)
    v, w, word = join(asked, 0, 0), join(asked, 0, 1), join(asked, 1, 0)
    n, c, distinct = join(got, 0, 0), join(got, 1, 0), join(got, 1, 1)
    kept = np.where(distinct > 0, c - DISCOUNT * distinct, 0.0)
    rank = np.argsort(word)

    def of(code: np.ndarray, head: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """A number of each word, from the automaton or from the answers."""
        at = lookup(word[rank], code)
        return np.where(code >= 0, head[np.maximum(code, 0)] if len(head) else 0.0, rare[rank[at]] if len(word) else 0.0)

    chance = (of(w, automaton.n, c) + 0.5) / (automaton.total + 0.5 * (automaton.distinct + 1))
    gain = np.log10(1 + np.maximum(n - DISCOUNT, 0) / ((of(v, automaton.n, c) - of(v, automaton.kept, kept) + PRIOR) * chance))
    uni = np.log10(c + 0.5) - automaton.log_total
    text = lambda counts: np.repeat(np.arange(len(counts)), counts)
    sums = lambda where, values: np.bincount(where, values, len(size))
    own = text(words_of_text)
    known = known + sums(own, (c > 0).astype(np.float64)[word_of]).astype(np.int64)
    base += sums(own, uni[word_of])
    score += sums(own, (uni + _log_back(c.astype(np.float64), kept))[word_of]) + sums(text(arcs_of_text), gain[arc_of])
    ids = rows["ids"][int(walk)].values
    return pa.table([ids, pa.array(size), pa.array(known), pa.array(base), pa.array(score)], ["id", *_SUMS])


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score."""
    automaton, buckets = model.automaton, model.buckets
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # HEAD words and ARCS arcs at most
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["batch", "bucket", "kind", "blob", "ids"]

    def walked(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        codes = np.concatenate([p[1] for p in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        walk = _Walk(shared.value, buckets, codes, first)
        asked = list(walk.asked())
        rows, n = [(-1, 0, walk.blob()), *((k, 2, x) for k, x in asked)], len(asked)
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (n + 1), pa.int32()), ids)
        cols = [pa.array([uuid.uuid4().hex] * (n + 1)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True))]
        return pa.RecordBatch.from_arrays([*cols, lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                h, first = tokens(c)
                parts.append((batch.column(0).slice(c.lo, c.hi - c.lo), shared.value.codes(h), first))
                held += len(h)
                if held >= BATCH:
                    yield walked(parts)
                    parts, held = [], 0
        if parts:
            yield walked(parts)

    # written once, as the names of batches are drawn at random
    rows = saved(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), f"batch string, bucket long, kind int, blob binary, ids array<{kind}>"), "walks")
    asks = rows.where("kind = 2").select("batch", "bucket", "blob")
    answers = asks.groupBy("bucket").cogroup(model.table.groupBy("bucket")).applyInArrow(_answered, "batch string, bucket long, kind int, blob binary")
    every = rows.unionByName(answers, allowMissingColumns=True)
    out = every.groupBy("batch").applyInArrow(lambda batch: _scored(shared.value, batch), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(automaton.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of score_rows, those of one id (or of no id) added up."""
    sums = [F.sum(k).alias(k) for k in _SUMS]
    return score_rows(docs, model, id_col, text_col).groupBy(id_col, "train_tokens").agg(*sums).select(id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of all tokens of a table of one text column."""
    return saved(_counts(texts, lambda c: tokens(c)[0]), "words")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    texts = docs.where(fold != 1).select("text")
    out = score_rows(docs, train(texts, word_counts(texts)))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
