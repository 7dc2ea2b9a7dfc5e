"""Operator 6: SentencePiece encoding and decoding in batched numpy.

A text is cut into units, a run of the space mark and the characters up to the next one;
no piece crosses a unit's end. Distinct units of equal length advance together: hashes of
all their substrings, from one prefix sum, probe the sorted keys of the vocabulary.
* Unigram models: Viterbi. Position by position, vectorised maxima over the pieces that
  end there store the best score and a backpointer for all units at once.
* BPE models, whose scores are merge ranks: the best segmentation by Viterbi is not what
  the model means, so merge rounds replace it on the same substring table. In each round a
  vectorised maximum picks every unit's best adjacent pair (the leftmost on ties) and
  joins it, until no joined pair is a piece.
Characters without a piece become byte pieces, or the unknown piece in a model without them.

The model file is a parameter; it is read on the driver and broadcast (a vocabulary's
size). Defined cases: null text has null ids; empty text has none; a literal space mark
decodes to a space; every row gives one row; extra columns are kept by encode() and
ignored by the queries. Texts whose length has no bound are held one at a time, and units
beyond LONG characters are merged with a heap (BPE) or in a banded pass (Viterbi).
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lane_hash, lookup, mix, powers, released, small_batches, table

MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = 0x2581  # the space mark of this model format
LONG = 200
_CELLS = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of one protobuf message; fixed-width values are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def _values(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _distinct(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a sample of each distinct unit, the distinct unit of each): by hash, then compared code by code."""
    raw, seed = flat.view(np.uint8), 0
    while True:
        h = lane_hash(raw, 4 * start, 4 * (start + size), seed)
        _, sample, unit = np.unique(h, return_index=True, return_inverse=True)
        like = sample[unit]
        if (size == size[like]).all():
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            if (flat[np.repeat(start, size) + at] == flat[np.repeat(start[like], size) + at]).all():
                return sample, unit
        seed += 1  # two units of one hash: another hash tells them apart


class Model:
    """The pieces of a model file as sorted substring hashes."""

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: list[int], bpe: bool, dummy_prefix: bool = True):
        """kinds: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""
        if 4 in kinds:
            raise ValueError("models with user-defined symbols are not supported")
        self.pieces, self.scores, self.bpe, self.dummy_prefix = pieces, np.asarray(scores, np.float64), bpe, dummy_prefix
        own = [i for i, k in enumerate(kinds) if k in (1, 5)]
        self.unk = kinds.index(2) if 2 in kinds else 0
        self.longest = max([len(pieces[i]) for i in own], default=1)
        keys = np.array([self.key(pieces[i]) for i in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own, np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces are equal")
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True
        self.byte_ids = np.full(256, -1, np.int64)
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        low = self.scores[own].min() if own else 0.0
        self.unk_score = low - 10.0
        self.raw = [p.encode() if k in (1, 5) else bytes([int(p[1:-1], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.raw = [r.replace("▁".encode(), b" ") for r in self.raw]

    @staticmethod
    def read(path: str) -> Model:
        """From a model file, by its wire format."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, kind, dummy, extra, rules = [], [], [], 1, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                pieces.append(got[1].decode())
                scores.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), np.float32)[0]))
                kinds.append(got.get(3, 1))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                got = dict(_fields(value))
                rules, dummy, extra = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if rules or extra:
            raise ValueError("models that normalise characters or drop white space are not supported")
        return Model(pieces, np.array(scores), kinds, kind == 2, dummy)

    @staticmethod
    def key(piece: str) -> int:
        values = _values(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
        with np.errstate(over="ignore"):
            return int(mix(np.array([(values * powers(len(values) + 1)[0][:-1]).sum()], np.uint64))[0])

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, unit, start] piece ids of all substrings of equal-length units, or -1."""
        m, n = codes.shape
        out = np.full((min(self.longest, n), m, n), -1, np.int32)
        with np.errstate(over="ignore"):
            pw, inv = powers(n + 1)
            total = np.zeros((m, n + 1), np.uint64)
            np.cumsum(_values(codes) * pw[:n], axis=1, out=total[:, 1:])
            for size in range(1, len(out) + 1):
                h = mix((total[:, size:] - total[:, : n + 1 - size]) * inv[: n + 1 - size])
                may = np.nonzero(self.bits[h >> np.uint64(44)])
                at = lookup(self.keys, h[may])
                out[size - 1][may] = np.where(at >= 0, self.ids[at] if len(self.ids) else -1, -1)
        return out

    # ------------------------------------------------------------ segmentation

    def _merge(self, codes: np.ndarray) -> np.ndarray:
        """Ends of the symbols that start at each place (0: none does), by merge rounds over all units."""
        m, n = codes.shape
        ids = self.substrings(codes)
        end = np.tile(np.arange(1, n + 1), (m, 1))
        before = np.tile(np.arange(-1, n - 1), (m, 1))
        score = np.full((m, n), -np.inf)

        def pair(rows: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
            size = k - i
            ok = size <= len(ids)
            found = np.where(ok, ids[np.minimum(size, len(ids)) - 1, rows, i], -1)
            return np.where(found >= 0, self.scores[found], -np.inf)

        if n > 1 and len(ids) > 1:
            found = ids[1][:, : n - 1]
            score[:, : n - 1] = np.where(found >= 0, self.scores[found], -np.inf)
        rows = np.arange(m)
        while len(rows):
            i = score[rows].argmax(1)
            go = score[rows, i] > -np.inf
            rows, i = rows[go], i[go]
            if not len(rows):
                break
            j = end[rows, i]
            k = end[rows, j]
            end[rows, i] = k
            end[rows, j] = 0
            score[rows, j] = -np.inf
            more = k < n
            before[rows[more], k[more]] = i[more]
            score[rows, i] = -np.inf
            r, a, b = rows[more], i[more], k[more]
            score[r, a] = pair(r, a, end[r, b])
            p = before[rows, i]
            has = p >= 0
            r, a, b = rows[has], p[has], k[has]
            score[r, a] = pair(r, a, b)
        return end

    def _viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Ends of the symbols of the best-scored segmentation, all units advancing together."""
        m, n = codes.shape
        ids = self.substrings(codes)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int64)
        for j in range(1, n + 1):
            for size in range(min(len(ids), j), 0, -1):
                found = ids[size - 1][:, j - size]
                s = np.where(found >= 0, self.scores[found], self.unk_score if size == 1 else -np.inf)
                s = best[:, j - size] + s
                better = s > best[:, j]
                best[better, j] = s[better]
                back[better, j] = j - size
        end = np.zeros((m, n), np.int64)
        at = np.full(m, n)
        rows = np.arange(m)
        while len(rows):
            start = back[rows, at]
            end[rows, start] = at
            keep = start > 0
            rows, at = rows[keep], start[keep]
        return end

    def _merge_long(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) symbols of one long unit by a heap of adjacent pairs."""
        n = len(codes)
        with np.errstate(over="ignore"):
            pw, inv = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_values(codes) * pw[:n], out=total[1:])
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(a: np.ndarray, b: np.ndarray) -> None:
            with np.errstate(over="ignore"):
                at = lookup(self.keys, mix((total[b] - total[a]) * inv[a]))
            for i, k, s in zip(a.tolist(), b.tolist(), at.tolist(), strict=True):
                if s >= 0:
                    heapq.heappush(heap, (-float(self.scores[self.ids[s]]), i, k))

        push(np.arange(n - 1), np.arange(2, n + 1))
        while heap:
            _, i, k = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or not end[j] or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                push(np.array([i]), np.array([end[k]]))
            if before[i] >= 0:
                push(np.array([before[i]]), np.array([k]))
        return [(i, k) for i, k in enumerate(end) if k]

    def _spell(self, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of symbols (ids, -1 for a character without a piece, whose code is given); repeats of each."""
        lost = np.flatnonzero(ids < 0)
        size = np.ones(len(ids), np.int64)
        if not len(lost):
            return ids, size
        if not self.has_bytes:
            out = ids.copy()
            out[lost] = self.unk
            return out, size
        chars = [chr(c).encode("utf-8", "surrogatepass") for c in codes[lost].tolist()]
        size[lost] = [len(c) for c in chars]
        out = np.repeat(ids, size)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        return out, size

    def encode_units(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, first id of each): flat holds code points; size is over 0."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, tokens of each, ids
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            if n > LONG and self.bpe:
                unit = order[at : at + 1]
                codes = flat[start[unit[0]] : start[unit[0]] + n]
                spans = np.array(self._merge_long(codes), np.int64)
                with np.errstate(over="ignore"):
                    pw, inv = powers(n + 1)
                    total = np.zeros(n + 1, np.uint64)
                    np.cumsum(_values(codes) * pw[:n], out=total[1:])
                    found = lookup(self.keys, mix((total[spans[:, 1]] - total[spans[:, 0]]) * inv[spans[:, 0]]))
                ids = np.where(found >= 0, self.ids[found], -1)
                out, reps = self._spell(codes[spans[:, 0]], ids)
                parts.append((unit, np.array([len(out)]), out))
                at += 1
                continue
            stop = int(np.searchsorted(size[order], n, "right"))
            stop = min(stop, at + max(1, _CELLS // (n * min(n, self.longest))))
            unit = order[at:stop]
            codes = flat[start[unit][:, None] + np.arange(n)]
            end = self._merge(codes) if self.bpe else self._viterbi(codes)
            rows, i = np.nonzero(end)
            ids = self._ids(codes, rows, i, end[rows, i])
            out, reps = self._spell(codes[rows, i], ids)
            parts.append((unit, np.bincount(rows, reps, len(unit)).astype(np.int64), out))
            at = stop
        counts = np.zeros(len(start), np.int64)
        for unit, n, _ in parts:
            counts[unit] = n
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(first[-1], np.int32)
        for unit, n, ids in parts:
            out[np.repeat(first[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, first

    def _ids(self, codes: np.ndarray, rows: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            pw, inv = powers(codes.shape[1] + 1)
            total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
            np.cumsum(_values(codes) * pw[: codes.shape[1]], axis=1, out=total[:, 1:])
            at = lookup(self.keys, mix((total[rows, k] - total[rows, i]) * inv[i]))
        return np.where(at >= 0, self.ids[at] if len(self.ids) else -1, -1)

    # ------------------------------------------------------------ texts

    def encode_chunk(self, c) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, first id of each text)."""
        codes = np.frombuffer(bytes(c.buf).decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])[c.offs]  # offsets in code points
        sizes = np.diff(lead)
        pad = (sizes > 0).astype(np.int64) * self.dummy_prefix
        offs = np.concatenate([[0], np.cumsum(sizes + pad)])
        flat = np.full(offs[-1], MARK, np.uint32)
        flat[np.arange(len(codes)) + np.repeat(np.cumsum(pad), sizes)] = np.where(codes == 32, MARK, codes)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        mark = flat == MARK
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[offs[:-1][sizes > 0]] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, len(flat)))
        sample, unit = _distinct(flat, start, size)
        ids, first = self.encode_units(flat, start[sample], size[sample])
        n = np.diff(first)[unit]
        cum = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(first[unit] - cum[:-1], n) + np.arange(cum[-1])]
        return out, cum[np.searchsorted(start, offs)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for c in chunks(pa.array(texts, pa.string())):
            ids, first = self.encode_chunk(c)
            out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _schema(docs: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [more])


def encode(docs: DataFrame, model: Model, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with the token ids of every whole text appended (null where the text is null), in place of such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(to)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(at).is_null()
            for c in chunks(batch.column(at)):
                ids, first = shared.value.encode_chunk(c)
                gone = missing.slice(c.lo, c.hi - c.lo)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))
                if gone.true_count:
                    lists = pa.compute.if_else(gone, pa.nulls(len(lists), lists.type), lists)
                part = batch.slice(c.lo, c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, to])

    return docs.mapInArrow(released(run), _schema(docs, f"`{to}` array<int>"))


def decode(rows: DataFrame, model: Model, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """rows with the text of the token ids appended (null where the ids are null), in place of such a column."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop(to)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            texts = [shared.value.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return rows.mapInArrow(released(run), _schema(rows, f"`{to}` string"))


def round_trip(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip (decoding gives the text back), in one pass of one Python worker."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            for c in chunks(texts):
                ids, first = model.encode_chunk(c)
                own = texts.slice(c.lo, c.hi - c.lo)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))
                if own.null_count:
                    lists = pa.compute.if_else(own.is_null(), pa.nulls(len(lists), lists.type), lists)
                same = [t is None or t == model.decode(ids[a:b].tolist()) for t, a, b in zip(own.to_pylist(), first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), lists, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, token_ids array<int>, round_trip boolean")
    return out.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token ids of every text kept, with the check that they decode to it."""
    return round_trip(docs)
