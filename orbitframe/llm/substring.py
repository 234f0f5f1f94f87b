"""Substring dedup on a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Removed are the words of every window whose sequence also starts
earlier in the corpus (smaller doc_id, or the same doc_id and a smaller row key, or same row and earlier start).

Rows. A row is known by its key, a 64-bit hash of doc_id and text, together with its doc_id, so rows that share a
doc_id, or have none, are rows of their own. Rows equal in both are copies: a window and its place are met again
in a copy, which marks the row (``COPY`` among its starts); one of the copies stays and the others lose all windows.

The index. Each window is filed under its anchor: the ``gram``-word hash that is smallest within it (the leftmost
on a tie). Equal windows have equal anchors, and about one word in seven is an anchor, so the index is
several times smaller than one of all windows, and misses nothing. A batch of documents becomes an immutable
run: per bucket a sorted array of anchor hashes, each with the first document that has it and whether that
document is known as a candidate already. Runs of earlier batches are merge-joined with the new batch bucket
by bucket; anchors met twice make their documents candidates. When more than ``fanout`` runs exist, they are
merged into one and the old ones deleted.

Verification. Candidates' windows (only those under shared anchors) get 128-bit hashes, two independent ones
of 64 bits over the window's words, and are compared on all 128 bits together with their order in the corpus;
all but the first of each are repeats. Windows go to buckets by their anchor, so that neighbours stay together
and a bucket says in one row what it found of a stretch of a document.

Hot keys. A task sends each anchor, and each window, once per slice of text, with the first place it has; the
others of the slice are settled on the spot. So a passage that a third of all documents hold reaches its bucket
once per few thousand documents. Buckets are packed arrays, not rows.

An index that lives on. ``FingerprintIndex.opened`` takes up the index in a folder, and ``deliver`` brings it documents: their windows
are held against all that was delivered before, and they become part of it. Ids ascend from delivery to delivery (checked), so
a delivery never changes what an earlier one lost, and deliveries one after the other remove what one pass over all would. The
folder holds runs, the anchors of candidates and a manifest. The manifest of a delivery is written last and names all that counts; files it no longer
names go after that. A delivery that dies, at any point, leaves the index as it was, and is simply made again. Texts stay with the caller,
who gives the earlier documents as ``history``; of these only the ones that share an anchor with the delivery are taken into its windows.

Defined cases: null text has no words; documents shorter than a window lose nothing; null doc_ids stand first;
rows of one doc_id are ordered by their keys; repeated rows lose all but the first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta
from orbitframe.llm.settings import matching, remove, scratch, shuffle_partitions, written

WIDTH, GRAM = 20, 6
NO_ID = -(1 << 63)
ANCHOR, RUN, CANDIDATE = 0, 1, 2  # kinds of rows on the way to and from a bucket
ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("known", "u1")])
WINDOW = np.dtype([("hash", "<u8"), ("hash2", "<u8"), ("doc", "<u2"), ("start", "<u4")])
ROW = np.dtype([("doc", "<i8"), ("key", "<i8")])
COPY = 0xFFFFFFFF  # no window starts there
MOVED = "kind int, bucket long, doc_id long, key long, body binary, ids binary"


def slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """At most 65,535 rows a slice, so that a row's number fits two bytes."""
    for lo, hi in ta.slices(off):
        for a in range(lo, hi, 0xFFFF):
            yield a, min(hi, a + 0xFFFF)


def anchors(words: ta.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their row, the word index of each one's anchor)."""
    n = np.diff(words.rows)
    count = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    start = words.rows[:-1][row] + ta.ranges(count)
    if not len(start):
        return start, row, start
    grams = words.grams(gram)
    span = width - gram + 1
    # Sliding minimum by doubling; the low bits of a value hold how far right its gram lies, so ties go left.
    low = (grams & ~ta.U64(31)).copy()
    reach, best = 1, low
    at = np.zeros(len(low), np.int64)
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[: len(best) - step], best[step:]
        left = a <= b
        at = np.where(left, at[: len(a)], at[step:] + step)
        best = np.where(left, a, b)
        reach += step
    return start, row, start + at[start]


def packed_rows(kind: int, bucket: np.ndarray, body: np.ndarray, ids=None) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, body = bucket[order], body[order]
    found, first = np.unique(bucket, return_index=True)
    out = []
    for b, s, e in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)]):
        part = body[s:e]
        own = None
        if ids is not None:
            docs, local = np.unique(part["doc"], return_inverse=True)
            part = part.copy()
            part["doc"], own = local, ids[docs].tobytes()
        out.append((kind, b, None, None, part.tobytes(), own))
    return out


def per_document(kind: int, bucket: int, key: np.ndarray, value: np.ndarray, doc: np.ndarray | None = None) -> list[tuple]:
    """One row per document with its values. Without ``doc``, keys alone name documents."""
    order = np.argsort(key, kind="stable") if doc is None else np.lexsort((doc, key))
    key, value = key[order], value[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    docs = None
    if doc is not None:
        doc = doc[order]
        head[1:] |= doc[1:] != doc[:-1]
        docs = doc[head].tolist()
    first = np.flatnonzero(head)
    return [(kind, bucket, docs and docs[i], k, value[s:e].tobytes(), None) for i, (k, s, e) in enumerate(zip(key[head].tolist(), first.tolist(), [*first[1:].tolist(), len(key)]))]


def repeats(body: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows are not the first of theirs, their starts or COPY) of windows sorted by hash, doc, key and start."""
    head = np.ones(len(body), bool)
    head[1:] = (body["hash"][1:] != body["hash"][:-1]) | (body["hash2"][1:] != body["hash2"][:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    start = body["start"]
    copy = (doc == doc[first]) & (key == key[first]) & (start == start[first])
    return ~head, np.where(copy, np.uint32(COPY), start)[~head]


def moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "doc_id", "key", "body", "ids"])


def anchor_messages(buckets: int, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ta.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(off):
                words = ta.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                _, row, at = anchors(words, width, gram)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                at, doc = at[new], ids[lo:hi][row[new]]
                key = words.grams(gram)[at]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                size = np.diff(np.append(np.flatnonzero(head), len(key)))
                shared = np.repeat(size > 1, size)
                entries = np.empty(int(head.sum()), ENTRY)
                entries["hash"], entries["doc"], entries["known"] = key[head], doc[head], size > 1
                rows = packed_rows(ANCHOR, (ta.mix(entries["hash"]) % ta.U64(buckets)).astype(np.int64), entries)
                spread = int(ids[lo]) % buckets
                rows += per_document(CANDIDATE, spread, doc[shared], key[shared])
                yield moved(rows)

    return run


def merge(new: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the new run, the entries that become candidates) of one bucket; both sides sorted by hash once joined."""
    both = np.concatenate([new, old])
    fresh = np.repeat([True, False], [len(new), len(old)])
    order = np.lexsort((both["doc"], both["hash"]))
    both, fresh = both[order], fresh[order]
    head = np.ones(len(both), bool)
    head[1:] = both["hash"][1:] != both["hash"][:-1]
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    size = np.diff(np.append(first, len(both)))
    known = np.add.reduceat(both["known"].astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    old_known = np.add.reduceat((both["known"] & ~fresh).astype(np.int64), first) > 0 if len(first) else known
    shared = (size > 1) | known
    out = shared[group] & (both["known"] == 0) & (fresh | ~old_known[group])
    has_new = np.add.reduceat(fresh.astype(np.int64), first) > 0 if len(first) else known
    run = both[first[has_new]].copy()
    run["known"] = shared[has_new]
    return run, both[out]


def merge_bucket(table: pa.Table) -> pa.Table:
    """A bucket's new messages, against its part of every run."""
    kinds, bucket = table["kind"].to_pylist(), table["bucket"][0].as_py()
    bodies, keys = table["body"], table["key"].to_pylist()
    of = lambda want: np.concatenate([np.zeros(0, ENTRY), *(np.frombuffer(bodies[i].as_py(), ENTRY) for i, k in enumerate(kinds) if k == want)])
    rows = [(CANDIDATE, bucket, None, keys[i], bodies[i].as_py(), None) for i, k in enumerate(kinds) if k == CANDIDATE]
    new, old = of(ANCHOR), of(RUN)
    if len(new):
        run, found = merge(new, old)
        rows.append((RUN, bucket, None, None, run.tobytes(), None))
        rows += per_document(CANDIDATE, bucket, found["doc"], found["hash"])
    return pa.Table.from_batches([moved(rows)]) if rows else pa.Table.from_batches([moved([(-1, bucket, None, None, None, None)])])


def compact_bucket(table: pa.Table) -> pa.Table:
    both = np.concatenate([np.frombuffer(b, ENTRY) for b in table["body"].to_pylist()])
    order = np.lexsort((both["doc"], both["hash"]))
    both = both[order]
    head = np.ones(len(both), bool)
    head[1:] = both["hash"][1:] != both["hash"][:-1]
    first = np.flatnonzero(head)
    run = both[first].copy()
    run["known"] = np.maximum.reduceat(both["known"], first)
    return pa.Table.from_batches([moved([(RUN, table["bucket"][0].as_py(), None, None, run.tobytes(), None)])])


@dataclass
class FingerprintIndex:
    """Immutable sorted runs in the shared store, one row per bucket and run."""

    spark: SparkSession
    path: str
    buckets: int
    width: int = WIDTH
    gram: int = GRAM
    fanout: int = 2
    runs: list[str] = field(default_factory=list)
    made: int = 0
    durable: bool = False  # files of earlier deliveries stay until a manifest that doesn't name them is written
    candidates: list[str] = field(default_factory=list)
    stale: list[str] = field(default_factory=list)
    version: int = 0
    last_id: int | None = None
    made_candidates: int = 0

    @classmethod
    def opened(cls, spark: SparkSession, path: str, buckets: int | None = None, width: int = WIDTH, gram: int = GRAM, fanout: int = 2) -> FingerprintIndex:
        """The index of a folder of the shared store as its last whole delivery left it; a new one where there is none.

        Buckets, width and gram are those it was made with; another width or gram is an error.
        """
        path = path.rstrip("/")
        found = [int(p.rsplit("/", 2)[-2].rpartition("-")[2]) for p in matching(spark, f"{path}/manifest-*/_SUCCESS")]
        if not found:
            return cls(spark, path, buckets or 4 * shuffle_partitions(spark), width, gram, fanout, durable=True)
        kept = json.loads(spark.read.text(f"{path}/manifest-{max(found)}").first()[0])
        if (kept["width"], kept["gram"]) != (width, gram):
            raise ValueError(f"the index in {path} has windows of {kept['width']} words and grams of {kept['gram']}")
        named = lambda names: [f"{path}/{n}" for n in names]
        return cls(spark, path, kept["buckets"], width, gram, fanout, named(kept["runs"]), kept["made"], True, named(kept["candidates"]), named(kept["stale"]), max(found), kept["last_id"])

    def commit(self) -> None:
        """Writes the manifest, then removes what it doesn't name. ``stale`` is in it too, so that a crash in between leaves no litter."""
        names = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
        text = json.dumps({"buckets": self.buckets, "width": self.width, "gram": self.gram, "made": self.made, "last_id": self.last_id,
                           "runs": names(self.runs), "candidates": names(self.candidates), "stale": names(self.stale)})
        self.version += 1
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.version}")
        for old in [*self.stale, f"{self.path}/manifest-{self.version - 1}"]:
            remove(self.spark, old)
        self.stale = []

    def deliver(self, docs: DataFrame, history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """Rows of ``dedup_substrings`` for docs(doc_id, text), held against themselves and all delivered before.

        ``history``: the documents (doc_id, text) of all earlier deliveries. It may be left out on the first one only.
        """
        docs = keyed(docs)
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.last_id is not None:
            if low <= self.last_id:
                raise ValueError(f"doc_ids of a delivery must be greater than {self.last_id}, the largest delivered before")
            if history is None:
                raise ValueError("the documents of earlier deliveries are needed to verify windows")
        earlier = [self.spark.read.parquet(p) for p in self.candidates]
        found = self.add(docs.select("key", "text"))
        self.candidates.append(f"{self.path}/candidates-{self.made_candidates}")
        pool, shared = docs, found
        if history is not None and self.last_id is not None:
            old = keyed(history).filter(F.col("doc_id") <= self.last_id)
            per_anchor = found.mapInArrow(unpacked_anchors, "key long, hash long")
            asked = per_anchor.join(docs.select("key").distinct(), "key", "left_semi").select("hash").distinct()
            every = per_anchor
            for e in earlier:
                every = every.unionByName(e.mapInArrow(unpacked_anchors, "key long, hash long"))
            near = every.join(asked, "hash", "left_semi").groupBy("key").agg(F.collect_list("hash").alias("hashes"))
            shared, pool = near.mapInArrow(packed_anchors, "key long, body binary"), docs.unionByName(old)
        at = f"{self.path}/rows-{self.made}"
        rows = written(without_repeats(docs, pool, shared, self.buckets, with_text, self.width, self.gram), at)
        if high is not None:
            self.last_id = max(high, self.last_id if self.last_id is not None else high)
        self.commit()
        return rows

    def add(self, docs: DataFrame) -> DataFrame:
        """Merge-joins a batch (key, text) with all runs, adds its run, and returns (key, body): candidates' shared anchors."""
        at = f"{self.path}/batch-{self.made}"
        self.made += 1
        work = docs.mapInArrow(anchor_messages(self.buckets, self.width, self.gram), MOVED)
        for run in self.runs:
            work = work.unionByName(self.spark.read.parquet(run).select("bucket", "body").selectExpr(f"{RUN} kind", "bucket", "cast(null as long) doc_id", "cast(null as long) key", "body", "cast(null as binary) ids"))
        out = written(work.groupBy("bucket").applyInArrow(merge_bucket, MOVED), at)
        run = f"{self.path}/run-{self.made}"
        written(out.filter(F.col("kind") == RUN).select("bucket", "body"), run)
        self.runs.append(run)
        found = written(out.filter(F.col("kind") == CANDIDATE).select("key", "body"), f"{self.path}/candidates-{self.made}")
        remove(self.spark, at)
        self.made_candidates = self.made
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def compact(self) -> None:
        """One run of all, then the old ones go."""
        self.made += 1
        merged = f"{self.path}/run-{self.made}"
        written(self.spark.read.parquet(*self.runs).select("bucket", "body").groupBy("bucket").applyInArrow(compact_bucket, MOVED).select("bucket", "body"), merged)
        if self.durable:
            self.stale += self.runs
        else:
            for old in self.runs:
                remove(self.spark, old)
        self.runs = [merged]


def unpacked_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, body) -> a row per anchor hash."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            bodies = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column(1)[lo : lo + 1000]]
            keys = np.repeat(batch.column(0).to_numpy()[lo : lo + 1000], [len(b) for b in bodies])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(bodies), pa.int64())], ["key", "hash"])


def packed_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [np.unique(h.values.to_numpy()).tobytes() for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["key", "body"])


def window_messages(buckets: int, width: int, gram: int):
    """Windows under shared anchors: the first of each in a slice goes to its bucket, later ones are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ta.utf8(batch.column(2))
            ids = np.empty(batch.num_rows, ROW)
            ids["doc"], ids["key"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in slices(off):
                words = ta.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], second=True)
                start, row, at = anchors(words, width, gram)
                if not len(start):
                    continue
                key = words.grams(gram)[at]
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                keep = np.zeros(len(start), bool)
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
                    wanted = np.concatenate([np.frombuffer(b.as_buffer(), ta.U64) for b in batch.column(3)[lo + row[s]].values])
                    keep[s:e] = np.isin(key[s:e], wanted)
                start, row, key = start[keep], row[keep], key[keep]
                if not len(start):
                    continue
                body = np.empty(len(start), WINDOW)
                body["hash"], body["hash2"] = words.grams(width)[start], words.grams(width, second=True)[start]
                body["start"] = start - words.rows[row]
                body["doc"] = row
                doc, own = ids["doc"][lo:hi][row], ids["key"][lo:hi][row]
                order = np.lexsort((body["start"], own, doc, body["hash2"], body["hash"]))
                body, doc, own, key = body[order], doc[order], own[order], key[order]
                again, starts = repeats(body, doc, own)
                rows = packed_rows(ANCHOR, (ta.mix(key[~again]) % ta.U64(buckets)).astype(np.int64), body[~again], ids[lo:hi])
                rows += per_document(CANDIDATE, int(ids["key"][lo]) % buckets, own[again], starts, doc[again])
                yield moved(rows)

    return run


def repeats_of_bucket(table: pa.Table) -> pa.Table:
    """Per document, the starts of its windows that also start earlier."""
    kinds, bucket, bodies = table["kind"].to_pylist(), table["bucket"][0].as_py(), table["body"].to_pylist()
    rows = [(CANDIDATE, bucket, d, i, b, None) for k, d, i, b in zip(kinds, table["doc_id"].to_pylist(), table["key"].to_pylist(), bodies, strict=True) if k == CANDIDATE]
    body, own = [np.zeros(0, WINDOW)], [np.zeros(0, ROW)]
    for k, b, i in zip(kinds, bodies, table["ids"].to_pylist(), strict=True):
        if k == ANCHOR:
            body.append(np.frombuffer(b, WINDOW))
            own.append(np.frombuffer(i, ROW)[body[-1]["doc"]])
    body, own = np.concatenate(body), np.concatenate(own)
    order = np.lexsort((body["start"], own["key"], own["doc"], body["hash2"], body["hash"]))
    body, doc, key = body[order], own["doc"][order], own["key"][order]
    again, starts = repeats(body, doc, key)
    rows += per_document(CANDIDATE, bucket, key[again], starts, doc[again])
    return pa.Table.from_batches([moved(rows or [(-1, bucket, None, None, None, None)])])


def kept_words(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copied = set()  # rows met that have copies; all copies of a row are in one task
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                docs, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                data, off = ta.utf8(part.column(2))
                words = ta.Words(data, off)
                raw = data.tobytes()
                n, removed, sha, texts = [], [], [], []
                for r in range(part.num_rows):
                    a, b = int(words.rows[r]), int(words.rows[r + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    found = part.column(3)[r]
                    if found.is_valid:
                        own, blobs = found.values.flatten()
                        s = [np.frombuffer(blobs[i].as_buffer(), "<u4") for i in np.flatnonzero(own.to_numpy() == docs[r]).tolist()]
                        s = np.concatenate([np.zeros(0, "<u4"), *s]).astype(np.int64)
                        if (s == COPY).any():
                            if (docs[r], keys[r]) in copied:
                                s = np.arange(b - a - width + 1)
                            copied.add((docs[r], keys[r]))
                            s = s[s != COPY]
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + width, -1)
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    text = b" ".join(raw[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist()))
                    n.append(b - a)
                    removed.append(b - a - len(keep))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text.decode("utf-8"))
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string())] if with_text else out, [*names, "kept_text"] if with_text else names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text). A null doc_id stands first; with no nulls, both joins of texts read one and the same shuffle."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def without_repeats(docs: DataFrame, pool: DataFrame, found: DataFrame, buckets: int, with_text: bool, width: int, gram: int) -> DataFrame:
    """Keyed docs without the words of windows that start earlier in ``pool``, which has the docs and what they are held against."""
    parts = shuffle_partitions(docs.sparkSession)
    dealt = docs.repartition(parts, "key")
    against = dealt if pool is docs else pool.repartition(parts, "key")
    shared = found.groupBy("key").agg(F.collect_list("body").alias("anchors"))
    windows = against.join(shared.hint("shuffle_hash"), "key").select("doc_id", "key", "text", "anchors").mapInArrow(window_messages(buckets, width, gram), MOVED)
    again = windows.groupBy("bucket").applyInArrow(repeats_of_bucket, MOVED).filter("kind >= 0").groupBy("key").agg(F.collect_list(F.struct("doc_id", "body")).alias("starts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    kept = dealt.join(again.hint("shuffle_hash"), "key", "left").select("doc_id", "key", "text", "starts").mapInArrow(kept_words(width, with_text), schema)
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def dedup_substrings(docs: DataFrame, batches: int = 4, with_text: bool = False, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Whole corpus in ``batches`` ranges of doc_id through one index; then repeats are verified and removed."""
    spark = docs.sparkSession
    docs = keyed(docs)
    at = scratch(spark, "substring")
    index = FingerprintIndex(spark, at, 4 * shuffle_partitions(spark), width, gram)
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or [] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    found = None
    for lo, hi in zip(edges, edges[1:]):
        batch = docs
        if lo is not None:
            batch = batch.filter(F.col("doc_id") > lo)
        if hi is not None:
            batch = batch.filter(F.col("doc_id") <= hi)
        got = index.add(batch.select("key", "text"))
        found = got if found is None else found.unionByName(got)
    for run in index.runs:
        remove(spark, run)
    return without_repeats(docs, docs, found, index.buckets, with_text, width, gram)
