"""Packing documents into training sequences by shortest-pack-first over the length histogram.

1. Each document is tokenised and closed by one end id; whole pieces of ``size`` ids are cut off its front,
   the rest is its last piece. One row of figures per piece is written; ids never leave the task.
2. The histogram of piece lengths (at most ``size`` counts, whatever the corpus) goes to the driver. Lengths
   are placed longest first, each into the open pattern with the most room; patterns carry counts. New packs take
   as many pieces of their length as fit.
3. Patterns join back to pieces by (length, rank). Ranks come from two-level numbering (length, salt), so a
   length that most pieces share is spread over ``SALTS`` groups.

Tokenising is exact and done once per distinct unit of a slice: a unit is a run of white space with the run
of other characters after it, and the tokeniser's pattern never matches across the start of a unit. Texts
where that could fail (white space outside ASCII, special tokens written out) go to the tokeniser whole.

Defined cases: null text is empty, so only the end id; repeated doc_ids are separate documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta
from orbitframe.llm.settings import scratch, written

SIZE, END_ID, SALTS = 2048, 1, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SPECIAL = b"<|"


class UnitTokenizer:
    """Byte-level BPE ids for a slice of texts, each distinct unit encoded once."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.name, self.slow = name, None
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def whole(self, text: str) -> np.ndarray:
        if self.slow is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, raw: bytes) -> np.ndarray:
        return self.fast.encode_to_numpy(raw.decode("utf-8"), disallowed_special=()).astype(np.uint32)

    def odd(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows whose units may not stand alone."""
        d = np.concatenate([data, np.zeros(2, np.uint8)])
        i = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | (data == SPECIAL[0]))
        a, b, c = d[i], d[i + 1], d[i + 2]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == SPECIAL[0]) & (b == SPECIAL[1])
        out = np.zeros(len(off) - 1, bool)
        out[np.searchsorted(off, i[hit], "right") - 1] = True
        return out

    def slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin)."""
        rows, n = len(off) - 1, len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        space = ta.SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[1:n] = space[1:] & ~space[:-1]
        begins[off] = True
        begins[n] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        bounds = pa.py_buffer(np.append(starts, n).astype(np.int64))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
        inverse = units.dictionary_encode().indices.to_numpy()  # compares bytes
        first = np.unique(inverse, return_index=True)[1]
        us, ue = starts[first], ends[first]
        alone = ~space[us] | space[ue - 1]
        together = np.flatnonzero(~alone)
        lengths = (ue - us)[together]
        text = data[np.repeat(us[together], lengths) + ta.ranges(lengths)].tobytes()
        ids = self.encode(text)
        upto = np.cumsum(self.lengths[ids])
        stops = np.searchsorted(upto, np.cumsum(lengths)) + 1
        counts = np.zeros(len(us), np.int64)
        counts[together] = np.diff(stops, prepend=0)
        where = np.zeros(len(us), np.int64)
        where[together] = stops - counts[together]
        tail, at = [ids], len(ids)
        for u in np.flatnonzero(alone):
            got = self.encode(data[us[u] : ue[u]].tobytes())
            counts[u], where[u] = len(got), at
            tail.append(got)
            at += len(got)
        pool = np.concatenate(tail)
        per = counts[inverse]
        out = pool[np.repeat(where[inverse], per) + ta.ranges(per)]
        bounds = np.append(0, np.cumsum(per))[np.searchsorted(starts, off)]
        odd = self.odd(data, off)
        if odd.any():
            parts = [self.whole(data[off[r] : off[r + 1]].tobytes().decode("utf-8")) if odd[r] else out[bounds[r] : bounds[r + 1]] for r in range(rows)]
            out, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return out, bounds


def pieces_of(size: int, end_id: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = UnitTokenizer(name)
        for batch in batches:
            data, off = ta.utf8(batch.column(1))
            for lo, hi in ta.slices(off):
                o = off[lo : hi + 1] - off[lo]
                ids, at = tokenizer.slice(data[off[lo] : off[hi]], o)
                n = np.diff(at) + 1
                flat = np.full(len(ids) + hi - lo, end_id, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n - 1)] = ids
                begin = np.append(0, np.cumsum(n))[:-1]
                k = -(-n // size)
                start = ta.ranges(k) * size
                total = np.repeat(n, k)
                length = np.minimum(size, total - start)
                a = np.repeat(begin, k) + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), k)))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with counts that use up the histogram.

    A length goes to the pack that is shortest so far, as long as any has room for it; packs opened for the rest of
    a length take as many of it as fit.
    """
    room: dict[int, list[tuple[list[int], int]]] = {}
    largest: list[int] = []

    def add(pattern: list[int], count: int, free: int) -> None:
        if not room.setdefault(free, []):
            heapq.heappush(largest, -free)
        room[free].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and largest and -largest[0] >= length:
            free = -largest[0]
            pattern, count = room[free].pop()
            if not room[free]:
                heapq.heappop(largest)
            used = min(count, left)
            if used < count:
                add(pattern, count - used, free)
            add([*pattern, length], used, free - length)
            left -= used
        fit = size // length
        for each, count in ((fit, left // fit), (left % fit, 1)):
            if each and count:
                add([length] * each, count, size - each * length)
    return [x for free in sorted(room) for x in room[free]]


def slots_of(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each (length, rank range) the sequences and the offset it goes to, sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def place(slots: dict[str, np.ndarray]):
    key = (slots["length"] << 48) + slots["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 48) + rank, "right") - 1
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            out += [pa.array(slots["sequence"][i] + rank - slots["rank"][i]), pa.array(slots["offset"][i])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_of(size, end_id, tokenizer), PIECES)
    pieces = written(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))), scratch(spark, "pieces"))
    counts = pieces.groupBy("length", "salt").count()
    histogram = {r["length"]: r["count"] for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    slots = slots_of(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.drop("salt", "before", "nth").mapInArrow(place(slots), f"{PIECES}, sequence_id long, offset long")
