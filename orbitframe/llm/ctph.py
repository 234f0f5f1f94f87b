"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk wherever its low bits are zero; one base-64 character
per chunk makes a signature. The block size is a power of two chosen from the length, so that a signature
holds up to LIMIT characters; a second signature at twice the block size makes neighbouring sizes
comparable. ``block:first:second`` is the fingerprint. Signatures at equal block sizes are compared by
edit distance, after a check that they share a run of COMMON characters at all.

Defined cases: null text is empty, with fingerprint ``1::``; equal texts, empty ones too, have likeness 1;
repeated doc_ids are ordered by text; null doc_ids come first; an empty table gives an empty result; a
single row is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta
from orbitframe.llm.settings import shuffle_partitions

WINDOW, LIMIT, LEAST, COMMON = 7, 64, 24, 4
CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = (ta.BYTE_VALUE >> ta.U64(32)).astype(np.uint32)
_POWER = [np.uint32(pow(0x01000193, j, 1 << 32)) for j in range(WINDOW)]


def rolling(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the last WINDOW bytes of its row."""
    v = _VALUE[data]
    r = v.copy()
    for j in range(1, WINDOW):
        r[j:] += v[:-j] * _POWER[j] if len(v) > j else v[:0]
    starts, n = off[:-1], np.diff(off)
    for p in range(WINDOW - 1):
        i = starts[n > p] + p
        r[i] = sum((v[i - j] * _POWER[j] for j in range(p + 1)), np.zeros(len(i), np.uint32))
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA77)
    r ^= r >> np.uint32(13)
    return r


def signatures(data: np.ndarray, off: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> list[str]:
    """One string per row from its chunk ends; what lies beyond LIMIT chunks joins the last one."""
    count = np.bincount(rows, minlength=len(off) - 1)
    nth = ta.ranges(count)
    keep = (nth < LIMIT - 1) | (nth == count[rows] - 1)
    ends, rows = ends[keep], rows[keep]
    starts = np.append(0, ends)[: len(ends)]
    starts = np.maximum(starts, off[rows])
    if not len(ends):
        return [""] * (len(off) - 1)
    text = CHARS[(ta.segment_hash(ta.BYTE_VALUE[data], starts, ends, ta._BYTE_BASE) >> ta.U64(58)).astype(np.int64)].tobytes().decode()
    bounds = np.append(0, np.cumsum(np.bincount(rows, minlength=len(off) - 1))).tolist()
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def fingerprints(data: np.ndarray, off: np.ndarray) -> list[str]:
    n = np.diff(off)
    rolled = rolling(data, off)
    log = np.zeros(len(n), np.int64)
    big = n > LIMIT
    log[big] = np.ceil(np.log2(n[big] / LIMIT)).astype(np.int64)
    row_of = np.repeat(np.arange(len(n)), n)
    low = np.full(len(data), 64, np.uint8)  # number of low zero bits, as far as block sizes need it
    level = np.flatnonzero((rolled & np.uint32(1)) == 0)
    low[:] = 0
    k = 1
    while len(level):
        low[level] = k
        level = level[(rolled[level] & np.uint32(1 << k)) == 0] if k < 31 else level[:0]
        k += 1

    def ends_at(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(low >= log[row_of]) + 1
        last = off[1:][n > 0]
        ends = np.union1d(ends, last)
        return ends, np.searchsorted(off, ends, "left") - 1 if len(ends) else ends

    def rows_right(ends: np.ndarray) -> np.ndarray:
        return row_of[ends - 1]

    while True:  # too few chunks: a smaller block, as often as needed
        ends, _ = ends_at(log)
        few = (np.bincount(rows_right(ends), minlength=len(n)) < LEAST) & (log > 0)
        if not few.any():
            break
        log[few] -= 1
    first = signatures(data, off, ends, rows_right(ends))
    ends, _ = ends_at(log + 1)
    second = signatures(data, off, ends, rows_right(ends))
    return [f"{1 << k}:{a}:{b}" for k, a, b in zip(log.tolist(), first, second, strict=True)]


def of_texts(column: pa.Array) -> list[str]:
    data, off = ta.utf8(column)
    out: list[str] = []
    for lo, hi in ta.slices(off):
        out += fingerprints(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one machine word per column (Myers' bit vectors)."""
    if not a or not b:
        return max(len(a), len(b))
    m = len(a)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = ones, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & ones
        pv = (mh << 1 & ones) | ~(xv | ph) & ones
        mv = ph & xv
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    short = min(len(a), len(b))
    if short < COMMON:
        return 0.0
    runs = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in runs for i in range(len(b) - COMMON + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 where block sizes are not compatible."""
    if x == y:
        return 1.0
    (k, a, b), (m, c, d) = x.split(":"), y.split(":")
    k, m = int(k), int(m)
    if k == m:
        return max(_alike(a, c), _alike(b, d))
    if k == 2 * m:
        return _alike(a, d)
    return _alike(b, c) if m == 2 * k else 0.0


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; the row after one is its neighbour, a guest row is nothing but a neighbour."""
    held = None
    for batch in batches:
        prints = of_texts(batch.column(3))
        part, guest, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = [x or "" for x in batch.column(3).to_pylist()]
        rows = list(zip(part, guest, ids, texts, prints, strict=True))
        rows, held = ([held] if held else []) + rows, rows[-1] if rows else held
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
        for i in range(0, len(pairs), 1000):
            some = pairs[i : i + 1000]
            edited = []
            for a, b in some:
                k = len(a[3]) // 4
                edited.append(a[3][: len(a[3]) - k] + b[3][:k])
            new = of_texts(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in some], pa.int64()),
                    pa.array([len(a[3]) for a, _ in some], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([a[4] for a, _ in some]),
                    pa.array(new),
                    pa.array([likeness(a[4], f) for (a, _), f in zip(some, new, strict=True)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in some], pa.float64()),
                ],
                [f.split()[0] for f in OUT.split(", ")],
            )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, which takes its end from the next document.

    Texts are dealt once, into ranges of doc_id. The first row of each range also goes, as a guest, to the
    range before it, so neighbours meet without a second shuffle; only one id per range reaches the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    parts = 2 * shuffle_partitions(docs.sparkSession)
    cuts = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10000).alias("c")).first()["c"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    firsts = {r["part"]: r["first"] for r in docs.select(part_of(key).alias("part"), key.alias("k")).groupBy("part").agg(F.min("k").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(np.int64), "right")
        return pd.Series([[p, before[i]] if i in before else [p] for i, p in zip(ids.tolist(), own.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(parts_of(key)).alias("guest", "part")).select("part", "guest", "doc_id", "text")
    dealt = dealt.repartition(max(1, len(order)), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(against_next, OUT)
