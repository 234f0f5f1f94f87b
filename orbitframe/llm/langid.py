"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the byte 3-, 4- and 5-grams of the text (A-Z lowered, other ASCII non-letters as space), hashed to
``buckets`` rows of an embedding table; a text is the mean of its rows. Training draws windows of random
length from a bounded sample (``per_language`` rows of each label, the first by a hash of the row id), so
that short texts are learned too. Part of the sample is kept aside: it sets the softmax temperature and the
confidence under which a text is rejected.

Only text enters a prediction, and only rows with an id are learned from. Defined cases: null text, or text without any letter, gives ``und`` with
score 0; repeated rows are predicted alike; with no labelled rows everything is ``und``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta

GRAMS, UNDETERMINED = (3, 4, 5), "und"
_CLASS = ta.LOWER.copy()
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


@dataclass(frozen=True)
class Config:
    per_language: int = 400
    buckets_log2: int = 16
    width: int = 16
    epochs: int = 4
    windows: int = 24
    rate: float = 0.5
    keep: float = 0.999
    seed: int = 5


def gram_ids(data: np.ndarray, bits: int) -> list[np.ndarray]:
    b = _CLASS[data].astype(np.uint32)
    out, h = [], b.copy()
    for n in range(1, max(GRAMS)):
        h = (h[:-1] * np.uint32(0x01000193)) ^ b[n:] if len(h) > 1 else h[:0]
        if n + 1 in GRAMS:
            x = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            out.append((x * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
    return out


class Model:
    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, bits: int, temperature: float, threshold: float):
        self.labels, self.table, self.bias, self.bits, self.temperature, self.threshold = labels, table, bias, bits, temperature, threshold

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean of the projected rows of each text's subwords; zero where a text has none."""
        # One more row of zeros, for where a segment ends with the slice.
        table = np.vstack([self.table, np.zeros((1, len(self.labels)), self.table.dtype)])
        total = np.zeros((len(off) - 1, len(self.labels)))
        count = np.zeros(len(off) - 1)
        for n, ids in zip(GRAMS, gram_ids(data, self.bits), strict=True):
            if not len(ids):
                continue
            lo, hi = off[:-1], np.maximum(off[1:] - n + 1, off[:-1])
            rows = np.flatnonzero(hi > lo)
            if not len(rows):
                continue
            got = table[np.append(ids, np.uint32(len(self.table)))]
            total[rows] += np.add.reduceat(got, np.stack([lo[rows], hi[rows]], 1).ravel(), axis=0, dtype=np.float64)[::2]
            count += hi - lo
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(data, off) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(texts: list[str], langs: list[str], config: Config = Config()) -> Model | None:
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(config.seed)
    size = 1 << config.buckets_log2
    table = ((rng.random((size, config.width)) - 0.5) / config.width).astype(np.float32)
    head = np.zeros((config.width, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    kept = [(t.encode(), labels.index(y)) for t, y in zip(texts, langs, strict=True) if any(c.isalpha() for c in t)]
    fit = [x for i, x in enumerate(kept) if i % 5] or kept
    held = [x for i, x in enumerate(kept) if i % 5 == 0] or kept
    examples = []
    for raw, y in fit:
        data = np.frombuffer(raw, np.uint8)
        for _ in range(config.windows):
            n = int(np.exp(rng.uniform(np.log(6), np.log(600))))
            a = int(rng.integers(0, max(1, len(data) - n + 1)))
            ids = np.concatenate(gram_ids(data[a : a + n], config.buckets_log2))
            if len(ids):
                examples.append((ids, y))
    steps, done = max(1, config.epochs * -(-len(examples) // 64)), 0
    for _ in range(config.epochs):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), 64):
            part = [examples[i] for i in order[k : k + 64]]
            rate = config.rate * (1 - done / steps) + 1e-3
            done += 1
            ids, y = np.concatenate([p[0] for p in part]), np.array([p[1] for p in part])
            counts = np.array([len(p[0]) for p in part])
            first = np.append(0, np.cumsum(counts))[:-1]
            mean = np.add.reduceat(table[ids], first, axis=0) / counts[:, None]
            z = mean @ head + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            back = (p @ head.T) / counts[:, None]
            head -= (rate / len(y) * 4) * (mean.T @ p)
            bias -= (rate / len(y)) * p.sum(axis=0)
            np.add.at(table, ids, np.repeat((-rate * 8 * back).astype(np.float32), counts, axis=0))
    model = Model(labels, (table @ head).astype(np.float32), bias.astype(np.float64), config.buckets_log2, 1.0, 0.0)
    raw = [r for r, _ in held]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    # The temperature comes from windows of the texts kept aside: whole texts are too easy to tell scores apart.
    short = []
    for r, y in held:
        for n in (4, 8, 16, 32, 64):
            a = int(rng.integers(0, max(1, len(r) - n + 1)))
            short.append((r[a : a + n], y))
    z = model.logits(np.frombuffer(b"".join(r for r, _ in short), np.uint8), np.append(0, np.cumsum([len(r) for r, _ in short])))
    y = np.array([y for _, y in short])
    best = np.inf
    for t in np.geomspace(0.05, 20, 60):
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
        if loss < best:
            best, model.temperature = loss, float(t)
    # Rejects less than 1 - keep of what looks like the sample, and nothing that is more likely right than not.
    sure = model.predict(np.frombuffer(b"".join(raw), np.uint8), off)[1]
    model.threshold = float(min(0.5, np.quantile(sure, 1 - config.keep)))
    return model


def fitted(docs: DataFrame, held_out, config: Config = Config()) -> Model | None:
    """The sample: per label the ``per_language`` ids with the smallest hashes; its size is bounded, whatever the table's.

    Most rows are left out by their hash alone, at a threshold from the label's number of ids, so that no label with
    most of the rows is ranked in one task. Labels are the model's classes, so a figure for each fits the driver.
    """
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    named = pool.select("lang", F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id"), F.lit(config.seed)).alias("h"))
    spread, most = 1 << 40, 1.75 * config.per_language + 100
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    below = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(spread * min(1.0, most / n)))))
    few = named.filter(F.pmod("h", F.lit(spread)) < F.element_at(below, F.col("lang"))).distinct()
    nth = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(spread)), "id")
    ids = few.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= config.per_language).select(F.col("lang").alias("l"), "id")
    # ids has per_language rows a label at most; rows that repeat an id count once, with their smallest text
    joined = pool.select("doc_id", "lang", "text").join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")))
    rows = joined.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(learned(config), "model binary").collect()  # the driver gets the model, never texts
    return pickle.loads(got[0]["model"]) if got else None


def learned(config: Config):
    def run(sample: pa.Table) -> pa.Table:
        rows = sorted(sample.to_pylist(), key=lambda r: (r["doc_id"], r["lang"]))
        model = train([r["text"] for r in rows], [r["lang"] for r in rows], config)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ta.utf8(batch.column(batch.schema.names.index("text")))
            n = len(off) - 1
            lang, score, sure = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
            for lo, hi in ta.slices(off, max(1 << 16, (2 << 20) // max(1, len(model.labels) if model else 1))):
                if model is None:
                    break
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                y, p = model.predict(part, o)
                letters = np.append(0, np.cumsum(_LETTER[part]))
                plain = letters[o[1:]] > letters[o[:-1]]
                for r in range(hi - lo):
                    if plain[r] or any(c.isalpha() for c in part[o[r] : o[r + 1]].tobytes().decode("utf-8")):
                        lang[lo + r], score[lo + r], sure[lo + r] = model.labels[y[r]], p[r], p[r] >= model.threshold
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"), pa.array(lang, pa.string()), pa.array(score), pa.array(sure)],
                [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "accepted"],
            )

    return run


def held_out_column():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row."""
    model = fitted(docs, held_out_column(), config)
    return docs.select("doc_id", held_out_column().alias("held_out"), "text").mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted_documents(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs without the rows that are rejected; rows pass as they are, so no join is needed and any column may be there."""
    model, at = fitted(docs, held_out_column(), config), docs.columns.index("text")
    judge = predictor(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (verdict,) = judge(iter([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])]))
            yield batch.filter(verdict.column("accepted"))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # columns by place, as a name may hold a dot
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
