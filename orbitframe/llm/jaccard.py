"""Near-duplicate texts: an exact n-gram Jaccard join by T-occurrence search (DivideSkip), and its components.

A document's set is its distinct word shingles (default: five words, A-Z lowered). Equal sets are one node.
Two sets of sizes m and n reach Jaccard t only if they share T = ceil(t (m + n) / (1 + t)) shingles, and then they
share one within the first n - ceil(t n) + 1 shingles of each, in any order that is the same for all. The order
here is by a sketch of shingle frequencies of fixed size, rarest first, so text that many documents share comes last.

1. One pass gives each row's set size and key, and the frequency sketch.
2. The inverted lists of these first shingles, the short lists, are built and stored. Postings go, packed, to buckets;
   equal sets of a slice are sent once; a list that the sketch calls long is dealt over several buckets by set.
3. Sets that are neighbours by size in a list are searched for each other first, each set for the one it meets most
   often. That joins most groups of copies, at one pair a set. Profiles (how many shingles fall to each of CELLS hash
   cells; for large sets, to cells that grow with the set) rule most other pairs out before any set travels.
4. What is left are lists whose members lie in several components. Those with the same smallest member are a shard:
   their members come together in blocks of bounded size, block by block, then block against
   block. In a shard every set is a query against the inverted lists of all the shard's sets: the short lists are merged, the L longest are only
   probed, by binary search, for candidates whose merged count reaches T - L. A candidate is a result when it reaches
   T, and only one result is given for two components that meet: rows grow with members, never with pairs.
   Members that no profile allows any partner in another component stay away from the search.

Only texts of sets that are searched travel: a bitmap of fixed size tells most others apart where they are read, a
join the rest.

Defined cases: null text and text without words have an empty set, linked with nothing; fewer words than the
shingle length make one shingle of all; repeated rows have equal sets; rows with a null doc_id link like all others,
and have the smallest doc_id of their component (null if it has none); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta
from orbitframe.llm.components import connected_components
from orbitframe.llm.mixing import row_keys
from orbitframe.llm.settings import scratch, shuffle_partitions, written

WORDS, PERCENT = 5, 75
TOKEN_BITS, SKETCH_BITS, BLOCK_BITS = 52, 20, 14
MASK = ta.U64((1 << TOKEN_BITS) - 1)
FAR = 0xFFFF
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22  # members of a shard, and their shingles, that a task searches at a time (against as many)
PIECES = 64  # in which the members of a shard are counted
CELLS_LOG2 = 7
CELLS = 1 << CELLS_LOG2
SIEVE_LOG2, SIEVE_PART = 23, 1 << 15  # bits of a sieve (1 MB), and of each of the bitmaps it is gathered in


def slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of at most 4096 rows, so that a row number and a token fit in one word."""
    most = 1 << (64 - TOKEN_BITS)
    for lo, hi in ta.slices(off):
        for a in range(lo, hi, most):
            yield a, min(hi, a + most)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, tokens, first index per row): each row's distinct shingles, ascending."""
    words = ta.Words(data, off, lower=True)
    n = np.diff(words.rows)
    grams = words.grams(k)
    first = words.rows[:-1]
    count = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    token = grams[np.repeat(first, count) + ta.ranges(count)] if len(row) else np.zeros(0, ta.U64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = ta.keyed_hash(words.hash[np.repeat(first[short], n[short]) + ta.ranges(n[short])], n[short], ta.WORD_SEED)
        row, token = np.concatenate([row, short]), np.concatenate([token, whole])
    key = np.unique((row.astype(ta.U64) << ta.U64(TOKEN_BITS)) | (token & MASK))
    rows = (key >> ta.U64(TOKEN_BITS)).astype(np.int64)
    return rows, key & MASK, np.searchsorted(rows, np.arange(len(n) + 1))


def set_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(ta.U64(0), np.cumsum(ta.mix(tokens + ta.U64(0x632BE59BD9B4E019))))
    return ta.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(ta.U64)).view(np.int64)


def profiles(rows: np.ndarray, tokens: np.ndarray, n: int) -> list[bytes | None]:
    """One byte per cell; none for a set so large that a count doesn't fit, which is then never ruled out."""
    cell = (tokens >> ta.U64(TOKEN_BITS - CELLS_LOG2)).astype(np.int64)
    counts = np.bincount(rows * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS)
    fits = (counts.max(axis=1) < 256).tolist()
    packed = counts.astype(np.uint8)
    return [p.tobytes() if ok else None for p, ok in zip(packed, fits, strict=True)]


def fine_profiles(tokens: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """For sets of more than 2 CELLS: four bits per cell, one or two tokens to a cell; none if a count doesn't fit."""
    out: list[bytes | None] = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        counts, log2 = None, (hi - lo).bit_length() - 1
        if hi - lo > 2 * CELLS:
            counts = np.bincount((tokens[lo:hi] >> ta.U64(TOKEN_BITS - log2)).astype(np.int64), minlength=1 << log2)
        out.append(None if counts is None or counts.max() > 15 else (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes())
    return out


def fine_bound(x: bytes, y: bytes) -> int:
    """The most that two sets with these fine profiles share. The one with more cells is folded to the other's."""
    counts = []
    for blob in (x, y):
        packed = np.frombuffer(blob, np.uint8)
        counts.append(np.stack([packed & 15, packed >> 4], 1).ravel())
    u, v = sorted(counts, key=len)
    return int(np.minimum(u, v.reshape(len(u), -1).sum(axis=1)).sum(dtype=np.int64))


def measured(k: int):
    """kind 0: a row's id, text hash, set size, key and profiles; kind 1: a block of this task's shingle frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "id", "at", "n", "key", "counts", "fine"]
        for batch in batches:
            data, off = ta.utf8(batch.column(1))
            for lo, hi in slices(off):
                row, tokens, first = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                sketch += np.bincount((tokens & ta.U64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(sketch))
                m = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), batch.column(0).slice(lo, m), batch.column(2).slice(lo, m), pa.array(np.diff(first)), pa.array(set_keys(tokens, first)), pa.array(profiles(row, tokens, m), pa.binary()), pa.array(fine_profiles(tokens, first), pa.binary())], names)
        blocks = [zlib.compress(b.astype("<i8").tobytes(), 1) for b in sketch.reshape(-1, 1 << BLOCK_BITS)] if sketch.any() else []
        m = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.arange(m)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(blocks, pa.binary()), pa.nulls(m, pa.binary())], names)

    return run


def sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for b in table["counts"].to_pylist():
        total += np.frombuffer(zlib.decompress(b), np.int64)
    return pa.table({"id": pa.array([table["id"][0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def at_least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


class Parts:
    """Over how many parts a list is dealt, by its sketched count. What every cell of a full sketch has doesn't count."""

    def __init__(self, counts: np.ndarray):
        parts = np.ceil(np.maximum(counts - 4 * counts.mean(), 0) / BLOCK).astype(ta.U64)
        self.cells = np.flatnonzero(parts > 1)
        self.parts = np.append(parts[self.cells], ta.U64(1))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        cell = (tokens & ta.U64((1 << SKETCH_BITS) - 1)).astype(np.int64)
        i = np.searchsorted(self.cells, cell)
        return self.parts[np.where(np.append(self.cells, -1)[i] == cell, i, len(self.cells))]


def part_of(token: np.ndarray, key: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ta.mix(token ^ ta.mix(key)) % parts


def postings(ranks: np.ndarray, parts: Parts, buckets: int, k: int, percent: int):
    """One row per slice and bucket: the first shingles of sets that fall to it, packed. ranks: by cell of the sketch."""
    layout = np.dtype([("token", "<u8"), ("set", "<u2"), ("rest", "<u2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ta.utf8(batch.column(0))
            for lo, hi in slices(off):
                rows, tokens, first = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                if not len(tokens):
                    continue
                n = np.diff(first)
                keys = set_keys(tokens, first)
                one = np.zeros(len(n), bool)
                one[np.unique(keys, return_index=True)[1]] = True
                rank = ranks[(tokens & ta.U64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(ta.U64)
                order = np.argsort((rows.astype(ta.U64) << ta.U64(TOKEN_BITS)) | (rank << ta.U64(32)) | (tokens >> ta.U64(20)), kind="stable")
                length = np.where(one & (n > 0), n - at_least(n, percent) + 1, 0)
                row = np.repeat(np.arange(len(n)), length)
                pos = ta.ranges(length)
                token = tokens[order[first[row] + pos]]
                rest = np.minimum(n[row] - pos, FAR)
                part = part_of(token, keys[row].view(ta.U64), parts.of(token))
                bucket = (ta.mix(token + ta.mix(part)) % ta.U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                row, token, rest, bucket = row[by], token[by], rest[by], bucket[by]
                found, starts = np.unique(bucket, return_index=True)
                out = []
                for b, s, e in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
                    sets, local = np.unique(row[s:e], return_inverse=True)
                    packed = np.empty(e - s, layout)
                    packed["token"], packed["set"], packed["rest"] = token[s:e], local, rest[s:e]
                    out.append((b, packed.tobytes(), keys[sets].tobytes(), n[sets].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["bucket", "entries", "keys", "sizes"])

    return run, layout


LISTS = "kind int, a long, b long, size long, rest long, times long, part long"


def inverted_lists(layout: np.dtype, dealt_over: Parts, percent: int):
    """kind 0: a pair met in lists of two; kind 1: neighbours in a longer list; kind 2: a member of a longer list (a: list, b: set)."""

    def run(table: pa.Table) -> pa.Table:
        token, key, size, rest = [], [], [], []
        for e, k, n in zip(*(table[c].to_pylist() for c in ("entries", "keys", "sizes")), strict=True):
            x = np.frombuffer(e, layout)
            token.append(x["token"])
            key.append(np.frombuffer(k, np.int64)[x["set"]])
            size.append(np.frombuffer(n, "<u4")[x["set"]].astype(np.int64))
            rest.append(x["rest"].astype(np.int64))
        token, key, size, rest = map(np.concatenate, (token, key, size, rest))
        parts = dealt_over.of(token)
        again = np.unique(token, return_counts=True)
        keep = np.isin(token, again[0][again[1] > 1]) | (parts > 1)
        token, key, size, rest, parts = token[keep], key[keep], size[keep], rest[keep], parts[keep]
        part = part_of(token, key.view(ta.U64), parts).astype(np.int64)
        order = np.lexsort((key, size, part, token))
        token, key, size, rest, parts, part = token[order], key[order], size[order], rest[order], parts[order], part[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size, rest, parts, part = token[new], key[new], size[new], rest[new], parts[new], part[new]
        begins = np.ones(len(token), bool)
        begins[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(begins)
        count = np.diff(np.append(first, len(token)))
        many = (count > 2) | (parts[first] > 1)
        i = np.flatnonzero(~begins[1:]) if len(token) else first
        i = i[possible(size[i], size[i + 1], rest[i], rest[i + 1], percent)]
        pairs = np.stack([np.repeat(many, count)[i].astype(np.int64), key[i], key[i + 1]], 1)
        pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
        # Longer lists with the same members are one list; each member keeps the most it has left in any of them.
        # Parts of a list that is dealt over several keep its name, and all members: partners may be in another part.
        long_ = np.flatnonzero(many)
        keyed = np.append(ta.U64(0), np.cumsum(ta.mix(key.view(ta.U64))))
        same = ta.mix(keyed[first[long_] + count[long_]] - keyed[first[long_]] + count[long_].astype(ta.U64))
        dealt = parts[first[long_]] > 1
        name = np.where(dealt, ta.mix(token[first[long_]]), same)
        at = np.repeat(first[long_], count[long_]) + ta.ranges(count[long_])
        lid = np.repeat(name, count[long_])
        some = with_partner(first, count, size, rest, percent)[at] | np.repeat(dealt, count[long_])
        at, lid = at[some], lid[some]
        by = np.lexsort((-rest[at], key[at], lid))
        at, lid = at[by], lid[by]
        top = np.ones(len(at), bool)
        top[1:] = (lid[1:] != lid[:-1]) | (key[at][1:] != key[at][:-1])
        at, lid = at[top], lid[top]
        m, z = len(at), np.zeros(len(pairs), np.int64)
        columns = [
            np.append(pairs[:, 0], np.full(m, 2)).astype(np.int32),
            np.append(pairs[:, 1], lid.view(np.int64)),
            np.append(pairs[:, 2], key[at]),
            np.append(z, size[at]),
            np.append(z, rest[at]),
            np.append(times, np.zeros(m, np.int64)),
            np.append(z, part[at]),
        ]
        return pa.table(dict(zip((f.split()[0] for f in LISTS.split(", ")), columns, strict=True)))

    return run


def with_partner(first: np.ndarray, count: np.ndarray, size: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which entries have another one in their list, sorted by size, that sizes and positions allow."""
    out = np.zeros(len(size), bool)
    end = np.repeat(first + count, count)
    at = np.arange(len(size))
    step = 1
    while len(at):  # neighbours ever farther apart, as far as lists and sizes reach
        at = at[at + step < end[at]]
        at = at[size[at] * 100 >= size[at + step] * percent]
        ok = at[possible(size[at], size[at + step], rest[at], rest[at + step], percent)]
        out[ok] = out[ok + step] = True
        step += 1
        if step > 64:  # what is left of longer lists is kept
            out[at] = out[np.minimum(at + step, end[at] - 1)] = True
            tail = np.zeros(len(size) + 1, np.int64)
            np.add.at(tail, at, 1)
            np.add.at(tail, end[at], -1)
            out |= np.cumsum(tail)[:-1] > 0
            break
    return out


def needed(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """T: shingles that sets of sizes m and n must share."""
    return -(-(m + n) * percent // (100 + percent))


def possible(m: np.ndarray, n: np.ndarray, rest_m: np.ndarray, rest_n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow a link, and what is left from the shared shingle on does too."""
    sizes = np.minimum(m, n) * 100 >= np.maximum(m, n) * percent
    left = np.minimum(np.where(rest_m >= FAR, m, rest_m), np.where(rest_n >= FAR, n, rest_n))
    return sizes & (left >= needed(m, n, percent))


def members_left(percent: int):
    """Members of a shard that sizes, positions and profiles allow a partner in another component (and block, if there are two)."""

    def run(table: pa.Table) -> pa.Table:
        key, size, rest, comp, block = (table[c].to_numpy() for c in ("key", "size", "rest", "comp", "v"))
        order = np.lexsort((key, size))
        key, size, rest, comp, block = key[order], size[order], rest[order], comp[order], block[order]
        two = bool((block != block[0]).any())
        blobs = table["profile"].to_pylist()
        known = np.array([blobs[i] is not None for i in order.tolist()])
        profile = np.frombuffer(b"".join(blobs[i] or bytes(CELLS) for i in order.tolist()), np.uint8).reshape(-1, CELLS)
        left = np.zeros(len(key), bool)
        for i in range(len(key)):
            j = np.arange(i + 1, int(np.searchsorted(size, size[i] * 100 // percent, "right")))
            if left[i]:
                j = j[~left[j]]
            j = j[(comp[j] != comp[i]) & possible(size[i], size[j], rest[i], rest[j], percent)]
            if two:
                j = j[block[j] != block[i]]
            if len(j):
                bound = np.where(known[i] & known[j], np.minimum(profile[i], profile[j]).sum(axis=1, dtype=np.int64), size[i])
                j = j[bound >= needed(size[i], size[j], percent)]
                left[j] = True
                left[i] |= len(j) > 0
        m = int(left.sum())
        same = {c: table[c].take(pa.array(np.zeros(m, np.int64))) for c in ("shard", "x", "y")}
        return pa.table(same | {"key": key[left], "comp": comp[left], "v": block[left]})

    return run


def shard_search(percent: int):
    """Every set of a shard against the shard's inverted lists: links between sets of different components."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table["tokens"].combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1] // 8
        tokens = np.frombuffer(blobs.buffers()[2], ta.U64)
        size = np.diff(bounds)
        order = np.argsort(size, kind="stable")
        tokens = tokens[np.repeat(bounds[order], size[order]) + ta.ranges(size[order])]
        size = size[order]
        key, comp, block = (table[c].to_numpy()[order] for c in ("key", "comp", "v"))
        shard = Shard(tokens, size)
        label = np.unique(comp, return_inverse=True)[1]
        largest = np.bincount(label).argmax()
        two = bool((block != block[0]).any())
        a, b = [], []
        for q in np.flatnonzero(label != largest).tolist():  # a pair has at least one member outside the largest component
            may = label != label[q]
            if two:
                may &= block != block[q]
            hits = shard.search(q, may, percent)
            while len(hits):  # one link for each component met, which is then this one
                a.append(q)
                b.append(int(hits[0]))
                label[label == label[hits[0]]] = label[q]
                hits = hits[label[hits] != label[q]]
        return pa.table({"src": pa.array(key[a], pa.int64()), "dst": pa.array(key[b], pa.int64())})

    return run


class Shard:
    """Inverted lists over the sets of a shard, sorted by size. Lists hold members in ascending order."""

    def __init__(self, tokens: np.ndarray, size: np.ndarray):
        n = len(size)
        self.size, self.first = size, np.append(0, np.cumsum(size))
        owner = np.repeat(np.arange(n), size)
        names, self.token = np.unique(tokens, return_inverse=True)
        order = np.argsort(self.token, kind="stable")
        self.members = owner[order]
        self.length = np.bincount(self.token, minlength=len(names))
        self.start = np.append(0, np.cumsum(self.length))
        self.postings = self.token[order] * n + self.members  # ascending: a list is probed by binary search in it

    def search(self, q: int, may: np.ndarray, percent: int) -> np.ndarray:
        """Members among ``may`` that link with member q, by DivideSkip."""
        n, size = int(self.size[q]), self.size
        lo, hi = np.searchsorted(size, [-(-n * percent // 100), n * 100 // percent + 1])
        may = may[lo:hi]
        if not may.any():
            return np.zeros(0, np.int64)
        required = needed(np.int64(n), size[lo:hi], percent)
        mine = self.token[self.first[q] : self.first[q + 1]]
        mine = mine[self.length[mine] > 1]  # a list of q alone has no candidate
        least = int(required[0])
        if len(mine) < least:
            return np.zeros(0, np.int64)
        length = self.length[mine]
        skip = min(least - 1, int(least / (0.01 * np.log2(length.max()) + 1)))
        by = np.argpartition(length, len(mine) - skip - 1) if skip else np.arange(len(mine))
        short, long_ = mine[by[: len(mine) - skip]], mine[by[len(mine) - skip :]]
        met = self.members[np.repeat(self.start[short], self.length[short]) + ta.ranges(self.length[short])] - lo
        met = met[(met >= 0) & (met < hi - lo)]
        count = np.bincount(met, minlength=hi - lo)
        alive = np.flatnonzero(may & (count >= required - skip))
        if len(alive) and skip:
            probe = long_[:, None] * len(size) + (alive + lo)
            i = np.searchsorted(self.postings, probe)
            i[i == len(self.postings)] = 0
            count[alive] += (self.postings[i] == probe).sum(axis=0)
        return alive[count[alive] >= required[alive]] + lo


def searched(percent: int):
    """Rows (a, b, ta, tb) -> the pairs that link: one query each, probed in the other's sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = sorted((np.frombuffer(batch.column(c)[i].as_buffer(), ta.U64) for c in (2, 3)), key=len)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                ok[i] = int((y[at] == x).sum()) >= needed(np.int64(len(x)), np.int64(len(y)), percent)
            yield batch.select([0, 1]).filter(pa.array(ok)).rename_columns(["src", "dst"])

    return run


def not_ruled_out(percent: int):
    """Rows (a, b, ..., na, nb, pa, pb) whose profiles leave a link possible, without those four columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(batch.num_columns - i).to_numpy() for i in (4, 3))
            x, y = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            ok = np.minimum(m, n) * 100 >= np.maximum(m, n) * percent
            both = np.flatnonzero(ok & x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))
            for lo in range(0, len(both), 1 << 14):
                i = both[lo : lo + (1 << 14)]
                at = pa.array(i)
                u, v = (np.frombuffer(b"".join(c.take(at).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (x, y))
                ok[i] = np.minimum(u, v).sum(axis=1, dtype=np.int64) >= needed(m[i], n[i], percent)
            yield batch.select(list(range(batch.num_columns - 4))).filter(pa.array(ok))

    return run


def finely_possible(percent: int):
    """Rows (a, b, na, nb, fa, fb) whose fine profiles leave a link possible, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = needed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            x, y = batch.column(4), batch.column(5)
            ok = np.ones(len(least), bool)
            for i in np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)).tolist():
                ok[i] = fine_bound(x[i].as_buffer(), y[i].as_buffer()) >= least[i]
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def sieve_bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_LOG2))


def sieve(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every key is set."""
    bits = keys.select(sieve_bit(column).alias("bit"))
    parts = bits.groupBy(F.floor(F.col("bit") / SIEVE_PART).alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(SIEVE_PART))).alias("bits"))
    out = np.zeros((1 << SIEVE_LOG2) // 8, np.uint8)
    for r in parts.collect():  # 256 rows of 4 KB at most
        out[r["part"] * SIEVE_PART // 8 : (r["part"] + 1) * SIEVE_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_sieve(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def tokens_of(k: int, bits: np.ndarray):
    """(key, tokens) of rows (text, bit) whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_sieve(bits, batch.column(1).to_numpy())))
            data, off = ta.utf8(batch.column(0))
            for lo, hi in slices(off):
                _, tokens, first = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                blobs = [tokens[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(tokens, first)), pa.array(blobs, pa.binary())], ["key", "tokens"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    at = scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("at"))
    first = written(docs.mapInArrow(measured(words), "kind int, id long, at long, n long, key long, counts binary, fine binary"), f"{at}/measured")
    rows = first.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "key")
    blocks = first.filter("kind = 1").groupBy("id").applyInArrow(sum_blocks, "id long, counts binary").collect()  # 2**20 counts in all
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(blocks, key=lambda r: r["id"])]) if blocks else np.zeros(1 << SKETCH_BITS, np.int64)
    ranks = np.unique(counts, return_inverse=True)[1].astype(np.uint32)  # whatever the counts, a rank has 20 bits
    parts = Parts(counts)
    run, layout = postings(ranks, parts, shuffle_partitions(spark), words, percent)
    packed = docs.select("text").mapInArrow(run, "bucket long, entries binary, keys binary, sizes binary")
    lists = written(packed.groupBy("bucket").applyInArrow(inverted_lists(layout, parts, percent), LISTS), f"{at}/lists")
    # A set's figures follow from its key; texts with one set may differ, and the one with the smallest hash is read again.
    sets_seen = first.filter("kind = 0 and n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("counts").alias("profile"), F.first("fine").alias("fine"))
    reps = written(sets_seen, f"{at}/reps")

    def pruned(pairs: DataFrame, name: str) -> DataFrame:
        """pairs(a, b, ...) without those that profiles rule out."""
        cols = pairs.columns
        b = pairs.join(reps.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb")), "b")
        both = b.join(reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa")), "a")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return written(both.select(*cols, "na", "nb", "pa", "pb").mapInArrow(not_ruled_out(percent), schema), f"{at}/{name}")

    def token_sets(keys: DataFrame, name: str) -> DataFrame:
        """(key, tokens) of the sets in keys(key), and maybe of others: one pass over the texts, dealt by key."""
        wanted = written(reps.join(keys, "key", "left_semi").select("key", "at"), f"{at}/{name}-keys")
        some = docs.select("text", sieve_bit("at").alias("bit")).mapInArrow(tokens_of(words, sieve(wanted, "at")), "key long, tokens binary")
        return some.dropDuplicates(["key"])  # rows may repeat a text; a set is wanted once

    def narrowed(pairs: DataFrame, name: str) -> DataFrame:
        """pairs(a, b) without those that fine profiles rule out."""
        of = lambda x: reps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "fa", "fb")
        return written(both.mapInArrow(finely_possible(percent), "a long, b long"), f"{at}/{name}")

    def linked(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        b = pairs.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
        both = b.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(searched(percent), "src long, dst long"), f"{at}/{name}")

    met = pruned(lists.filter("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind"), F.sum("times").alias("times")), "met")
    best = met.groupBy("b").agg(F.max(F.struct("times", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    near = narrowed(met.filter("kind = 0").select("a", "b").unionByName(best).distinct(), "near")
    sets = written(token_sets(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-sets"), f"{at}/sets-0")
    links = linked(near, sets, "links-0")
    comps = connected_components(links)
    # Buckets name lists by their members, so lists of several buckets may be one: a member is in it once, however many buckets there are.
    named = lists.filter("kind = 2").groupBy(F.col("a").alias("list"), "part", F.col("b").alias("key"))
    members = written(named.agg(F.first("size").alias("size"), F.max("rest").alias("rest")), f"{at}/members")

    for k, across in ((1, False), (2, True)):
        shards = shards_of(members, comps, across)
        if across and not shards.limit(1).count():
            break
        left = shards.join(reps.select("key", "profile"), "key").groupBy("shard", "x", "y").applyInArrow(members_left(percent), "shard long, x long, y long, key long, comp long, v long")
        left = written(left, f"{at}/left-{k}")
        sets = token_sets(left.select("key").distinct(), f"sets-{k}")
        found = left.join(sets, "key").groupBy("shard", "x", "y").applyInArrow(shard_search(percent), "src long, dst long")
        links = links.unionByName(written(found.distinct(), f"{at}/links-{k}"))
        comps = connected_components(links)

    nodes = reps.select("key", "rep").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    smallest = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = nodes.join(smallest, "root").select("key", "component_id")
    done = rows.join(known, "key", "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def shards_of(members: DataFrame, components: DataFrame, across: bool) -> DataFrame:
    """Members of lists that lie in several components, by shard: (shard, x, y). x = y is one block, else two.

    Lists with the same smallest member share a shard, in which a set is once, in whatever number of the lists it is:
    copies of one text have most lists in common. A shard makes blocks of about BLOCK members and BLOCK_SHINGLES
    shingles at most, so that what a task holds is bounded.
    """
    comps = components.select(F.col("node").alias("key"), F.col("component").alias("_c"))
    tagged = members.join(comps, "key", "left").withColumn("comp", F.coalesce("_c", "key")).drop("_c")
    per = Window.partitionBy
    mixed = (
        tagged.groupBy("list", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("key").alias("least"))
        .withColumn("mixed", F.min("lo").over(per("list")) < F.max("hi").over(per("list"))).withColumn("shard", F.min("least").over(per("list")))
        .filter("mixed").select("list", "part", "shard")
    )
    once = tagged.join(mixed, ["list", "part"]).groupBy("shard", "key").agg(F.first("size").alias("size"), F.first("comp").alias("comp"), F.max("rest").alias("rest"))
    once = once.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(PIECES)))
    whole = lambda x: F.ceil(F.sum(x).over(per("shard")) / F.lit(float(BLOCK if x == "n" else BLOCK_SHINGLES)))
    sizes = once.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).select("shard", "piece", F.greatest(whole("n"), whole("shingles")).alias("blocks"))
    placed = once.join(sizes, ["shard", "piece"]).withColumn("v", F.pmod(F.xxhash64("key", F.lit(1)), "blocks")).select("shard", "v", "key", "size", "rest", "comp")
    if not across:
        return placed.withColumn("x", F.col("v")).withColumn("y", F.col("v"))
    there = placed.select("shard", "v").distinct()
    grid = there.withColumnRenamed("v", "x").join(there.withColumnRenamed("v", "y"), "shard").filter("x < y")
    return placed.join(grid.withColumn("v", F.explode(F.array("x", "y"))), ["shard", "v"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays, once.

    Rows with one doc_id are one document; of several, the one with the smallest hash stays. Rows without a doc_id
    stay, once per text.
    """
    kept = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    wide = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.struct(*row_keys(docs)).alias("h"), F.struct("*").alias("row"))
    named = wide.join(kept, F.col("id") == F.col("kept"), "left_semi").groupBy("id").agg(F.min_by("row", "h").alias("row"))
    nameless = wide.filter("id is null").groupBy("t").agg(F.min_by("row", "h").alias("row"))
    return named.select("row").unionByName(nameless.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
