"""Operator 5: secret scans by pattern and by sliding-window entropy.

Base spans come from three patterns. The entropy method looks at candidate strings (runs
of [A-Za-z0-9+/_=-] of 20 or more) of two or more kinds of characters. Over each window
of 20 characters the Shannon entropy is kept by incremental counts: one character enters,
one leaves, and the sum of c*log2(c) changes by their terms; all candidates of a batch
advance together. A window counts when its entropy passes the threshold of the
candidate's character class. Passing windows merge into spans of kind ``entropy``. An
allow-list suppresses placeholders, sequences and readable identifiers. Spans that overlap
a base span are not repeated; base spans are never suppressed.

Offsets are code points, ends exclusive. Null text counts as empty; empty texts have no
spans; every row gives one row, repeated ones too. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so this is AKIA[A-Z0-9]+ of 18 or more
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Bits a character that a window must reach, by class: hexadecimal digits, letters and digits, base64 alphabet.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that contain one of these, in any case, are not secrets.
ALLOW = ("example", "placeholder", "changeme", "xxxx", "0000000000", "1234567890", "abcdefghij", "lorem", "localhost")
_ALLOW = re.compile("|".join(ALLOW))
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def allowed(candidate: str) -> bool:
    """True where the allow-list says that this is no secret."""
    low = candidate.lower()
    if _ALLOW.search(low) or _UUID.fullmatch(candidate):
        return True
    if not (any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)):
        return True  # words, rules, card and phone numbers
    parts = re.split(r"[-_/+=]", candidate)
    return len(parts) > 1 and all(p.isalpha() or p.isdigit() or not p for p in parts)  # names, paths, dates


def classify(candidate: str) -> str:
    return "hex" if _HEX_ONLY.fullmatch(candidate) else "alnum" if candidate.isalnum() else "base64"


def window_entropy(strings: list[str], width: int = WINDOW) -> np.ndarray:
    """[string, window] entropies in bits, nan beyond a string's last window."""
    n, longest = len(strings), max(map(len, strings))
    codes = np.full((n, longest), 127, np.int64)
    for i, s in enumerate(strings):
        codes[i, : len(s)] = np.frombuffer(s.encode("ascii"), np.uint8)
    lengths = np.array([len(s) for s in strings])
    c = np.arange(width + 2, dtype=np.float64)
    term = np.zeros(width + 2)
    term[1:] = c[1:] * np.log2(c[1:])
    counts = np.zeros((n, 128), np.int64)
    rows, total = np.arange(n), np.zeros(n)
    out = np.full((n, longest - width + 1), np.nan)
    for j in range(longest):
        if j >= width:
            gone = codes[:, j - width]
            had = counts[rows, gone]
            total -= term[had] - term[had - 1]
            counts[rows, gone] -= 1
        had = counts[rows, codes[:, j]]
        total += term[had + 1] - term[had]
        counts[rows, codes[:, j]] += 1
        if j >= width - 1:
            out[:, j - width + 1] = np.where(j < lengths, np.log2(width) - total / width, np.nan)
    return out


#: Windows of a candidate that advance in one row; longer candidates take several rows, which overlap by a window less one.
PIECE = 2048
#: Cells of the array of windows that is held at once.
CELLS = 1 << 21


def entropy_spans(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Merged windows of high entropy of each text."""
    where, strings, out = [], [], [[] for _ in texts]
    for i, text in enumerate(texts):
        for m in CANDIDATE.finditer(text):
            if not allowed(m.group()):
                where.append((i, m.start()))
                strings.append(m.group())
    need = [THRESHOLDS[classify(s)] for s in strings]
    pieces = [(k, p) for k, s in enumerate(strings) for p in range(0, len(s) - WINDOW + 1, PIECE)]
    pieces.sort(key=lambda x: min(PIECE, len(strings[x[0]]) - x[1]))  # like lengths together
    high: list[list[np.ndarray]] = [[] for _ in strings]
    at = 0
    while at < len(pieces):
        # rows of at most the last one's length, within CELLS
        stop = min(len(pieces), at + 512)
        longest = min(PIECE + WINDOW - 1, len(strings[pieces[stop - 1][0]]) - pieces[stop - 1][1])
        stop = min(stop, at + max(1, CELLS // longest))
        part = pieces[at:stop]
        bits = window_entropy([strings[k][p : p + PIECE + WINDOW - 1] for k, p in part])
        rows, cols = np.nonzero(np.nan_to_num(bits, nan=-1.0) >= np.array([need[k] for k, _ in part])[:, None])
        cuts = np.searchsorted(rows, np.arange(len(part) + 1))
        for r, (k, p) in enumerate(part):
            if cuts[r] < cuts[r + 1]:
                high[k].append(cols[cuts[r] : cuts[r + 1]] + p)
        at = stop
    for k, parts in enumerate(high):
        if parts:
            windows = np.sort(np.concatenate(parts))
            i, start = where[k]
            for run in np.split(windows, np.flatnonzero(np.diff(windows) > WINDOW) + 1):
                out[i].append((start + int(run[0]), start + int(run[-1]) + WINDOW))
    return [sorted(x) for x in out]


def all_spans(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """(base spans, entropy spans that overlap none of them) of each text."""
    out = []
    for text, high in zip(texts, entropy_spans(texts), strict=True):
        base = base_spans(text)
        starts = [s for s, _, _ in base]
        ends = list(accumulate((e for _, _, e in base), max))  # the furthest end of the spans so far
        free = []
        for a, b in high:
            before = bisect_left(starts, b)  # base spans that start ahead of b
            if not before or ends[before - 1] <= a:
                free.append((a, b))
        out.append((base, free))
    return out


_SCHEMA = "id {}, n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts by kind, base and spans (kind:start:end, comma-joined)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, base_s, spans_s = [], [], []
            for base, more in all_spans(texts):
                n.append([sum(k == i for _, k, _ in base) for i in range(3)] + [len(more)])
                base_s.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                both = sorted([(a, k, b) for a, k, b in base] + [(a, 3, b) for a, b in more])
                spans_s.append(",".join(f"{(*KINDS, 'entropy')[k]}:{a}:{b}" for a, k, b in both))
            cols = np.array(n, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[:, i]) for i in range(4)), pa.array(base_s, pa.string()), pa.array(spans_s, pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(scan), _SCHEMA.format(kind)).withColumnRenamed("id", id_col)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_entropy")
