"""How the sources of a language differ in their words: every pair of sources, and the terms each one has too much of.

Systolic rotation. A language's kept terms are dealt to shards, its sources to blocks of ``BLOCK``; a task holds one
(language, shard, block), whose vectors stay where they are. Compressed vectors of the other blocks come by in
rounds: in round d, block b is visited by block b + d, round the circle of blocks, so each two blocks meet once,
at one of the two, and both directions are evaluated there. A task holds one block and one visiting vector at a
time. Sums over shards are added up afterwards; they are exact integers. Each source's own task keeps a heap of
the ``TOP`` terms of its shard, and the heaps are merged by rank.

Counting comes first: terms are counted per slice of text before any shuffle, then per (language, source, term),
so a frequent term or a hot source sends one row a task.

Defined cases: null text, language or source reads as ''; a group without kept terms has count 0 of every term, and
a language without kept terms gives 0 for each pair; a language with one source has no pairs; ties of a value go by
the item's bytes; rows count as documents whatever their ids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta
from orbitframe.llm.settings import scratch, written

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
BLOCK, SHARD_TERMS, COUNT_BYTES, HELD_PAIRS = 16, 8192, 8 << 20, 50_000
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # [^\x00-\x40\x5B-\x60\x7B-\x7F]


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of (lang, source, text)."""
    for batch in batches:
        _, sizes = ta.utf8(batch.column(2))
        for lo, hi in ta.slices(sizes, COUNT_BYTES):
            rows = batch.slice(lo, hi - lo)
            data, off = ta.utf8(rows.column(2))
            inside = TERM[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            starts = np.flatnonzero(begins)
            if not len(starts):
                continue
            at = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int64)
            letters = ta.LOWER[data[inside]]
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
            lang, source = (rows.column(c).dictionary_encode() for c in (0, 1))
            group_of = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            row = np.searchsorted(off, starts, "right") - 1
            size = len(terms.dictionary)
            each, n = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
            key, where, docs = np.unique(group_of[each // size] * size + each % size, return_inverse=True, return_counts=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, n)
            group = key // size
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    source.dictionary.take(pa.array(group % len(source.dictionary))),
                    terms.dictionary.take(pa.array(key % size)).cast(pa.large_string()).cast(pa.string()),
                    pa.array(total),
                    pa.array(docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def weight(n: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / (total + v)), exact for counts of any size."""
    whole, rest = np.divmod(n + 1, total + v)  # whole is 0, or 1 where a group's only term is counted
    if total + v < (1 << 63) // SCALE:
        return 1 + whole * SCALE + rest * SCALE // (total + v)
    return np.array([1 + int(w) * SCALE + int(r) * SCALE // (total + v) for w, r in zip(whole, rest, strict=True)], np.int64)


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


VECTOR = "lang string, shard int, source string, part string, payload binary, item string, value long"


def vector_and_heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (language, shard, source): its compressed counts, and the terms that it has most in excess of its language."""
    cells = pa.Table.from_batches(list(batches))
    if not len(cells):
        return
    lang, shard, source, v, total, lang_total = (cells.column(c)[0].as_py() for c in ("lang", "shard", "source", "v", "total", "lang_total"))
    index, n, lang_n = (cells.column(c).to_numpy() for c in ("index", "n", "lang_n"))
    order = np.argsort(index)
    gaps, sorted_n = np.diff(index[order], prepend=0).astype("<i4"), n[order].astype("<i8")
    rows = [(lang, shard, source, "vector", zlib.compress(gaps.tobytes() + sorted_n.tobytes(), 1), None, None)]
    p, q = weight(n, total, v), weight(lang_n, lang_total, v)
    over = np.flatnonzero(p > q)
    value, terms = excess(p[over], q[over]).tolist(), cells.column("term").take(pa.array(over)).cast(pa.binary()).to_pylist()
    best = heapq.nsmallest(TOP, zip([-x for x in value], terms, strict=True))
    rows += [(lang, shard, source, "term", None, t.decode(), -x) for x, t in best]
    columns = list(zip(*rows, strict=True))
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "shard", "source", "part", "payload", "item", "value"])


class Vector:
    """A source's weights in one shard: those of its own terms, and the one that all others have."""

    def __init__(self, source: str, payload: bytes | None, total: int, v: int):
        raw = zlib.decompress(payload) if payload else b""
        k = len(raw) // 12
        self.source = source
        self.index = np.cumsum(np.frombuffer(raw, "<i4", k)).astype(np.int64)
        self.p = weight(np.frombuffer(raw, "<i8", k, 4 * k).astype(np.int64), total, v)
        self.p0 = int(weight(np.zeros(1, np.int64), total, v)[0])

    def at(self, index: np.ndarray) -> np.ndarray:
        out = np.full(len(index), self.p0, np.int64)
        out[np.searchsorted(index, self.index)] = self.p
        return out


def meeting(a: Vector, b: Vector, terms: int) -> tuple[int, int]:
    """Summed excess of a over b and of b over a, over the ``terms`` kept terms of the shard."""
    index = np.union1d(a.index, b.index)
    p, q, rest = a.at(index), b.at(index), terms - len(index)
    d = (a.p0 - b.p0) ** 2
    square = (p - q) ** 2
    return int((square // q).sum()) + rest * (d // b.p0), int((square // p).sum()) + rest * (d // a.p0)


def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (lang, shard, host, round): round 0 is the resident block, then its visitors one vector at a time."""
    here, residents, sums = None, [], defaultdict(int)

    def flushed() -> pa.RecordBatch:
        lang, source, item = (list(x) for x in zip(*sums, strict=True)) if sums else ([], [], [])
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (lang, source, item)] + [pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])
        sums.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "host", "round", "source", "payload", "total", "v", "terms")), strict=True):
            lang, shard, host, turn, source, payload, total, v, terms = row
            if (lang, shard, host) != here:
                here, residents = (lang, shard, host), []
            if v:
                visitor = Vector(source, payload, total, v)
                for other in residents:
                    there, back = meeting(visitor, other, terms)
                    sums[lang, source, other.source] += there
                    sums[lang, other.source, source] += back
            else:
                visitor = Vector(source, None, 0, 1)
                for other in residents:
                    sums[lang, source, other.source] += 0
                    sums[lang, other.source, source] += 0
            if turn == 0:
                residents.append(visitor)
        if len(sums) > HELD_PAIRS:
            yield flushed()
    yield flushed()


def visits(blocks: str, block: str) -> F.Column:
    """Where a block's vectors go: (host, round), itself in round 0, then the half circle of blocks before it."""
    return F.expr(
        f"transform(filter(sequence(0, {blocks} div 2), d -> d = 0 OR 2 * d < {blocks} OR pmod({block} - d, {blocks}) < {block}),"
        f" d -> struct(pmod({block} - d, {blocks}) AS host, d AS round))"
    )


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source, part ``term`` for the top terms."""
    spark, at = docs.sparkSession, scratch(docs.sparkSession, "divergence")
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = read.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = written(
        counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("df"), F.row_number().over(term.orderBy("source")).alias("nth")).filter(F.col("df") >= min_docs).drop("df"),
        f"{at}/cells",
    )
    first = F.col("nth") == 1
    langs = cells.groupBy("lang").agg(F.count_if(first).alias("v"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("long")
    groups = (
        read.select("lang", "source").distinct().withColumn("nth", F.row_number().over(order) - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        .join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.expr(f"int(nth div {BLOCK})").alias("block"), F.expr(f"int((sources - 1) div {BLOCK} + 1)").alias("blocks"),
                *(F.coalesce(c, zero).alias(c) for c in ("v", "lang_total", "total")))
        .withColumn("shards", F.expr(f"int(greatest(1, (v + {SHARD_TERMS - 1}) div {SHARD_TERMS}))"))
    )
    groups = written(groups, f"{at}/groups")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    placed = cells.drop("nth").join(groups.select("lang", "source", "v", "lang_total", "total", "shards"), ["lang", "source"]).withColumn("shard", shard)
    placed = placed.withColumn("index", F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    placed = written(placed.drop("shards"), f"{at}/placed")
    vectors = written(placed.groupBy("lang", "shard", "source").applyInArrow(vector_and_heap, VECTOR), f"{at}/vectors")
    terms = placed.groupBy("lang", "shard").agg((F.max("index") + 1).cast("long").alias("terms"))
    moving = (
        groups.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
        .join(vectors.filter("part = 'vector'").select("lang", "shard", "source", "payload"), ["lang", "shard", "source"], "left")
        .join(terms, ["lang", "shard"], "left").withColumn("terms", F.coalesce("terms", zero))
        .withColumn("to", F.explode(visits("blocks", "block")))
        .select("lang", "shard", F.col("to.host").alias("host"), F.col("to.round").alias("round"), "source", "payload", "total", "v", "terms")
        .repartition("lang", "shard", "host").sortWithinPartitions("lang", "shard", "host", "round", "source")
    )
    pairs = moving.mapInArrow(rounds, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(vectors.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
