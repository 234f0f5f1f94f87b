"""Near-duplicate embeddings: navigable small-world graphs per shard, every shard queried, links verified.

Equal vectors of a label count once, with a weight. Each label is dealt to shards of about ``shard_rows``
vectors by hash; each shard becomes one graph, written to the shared store. Every pair of shards of a label is a
task of its own, so a label with most of the rows is many tasks: blocks of one shard's vectors query the other's
graph, and the other way round. In each block, a sample of the queries is held against brute force; while the audit
finds less than ``audit_recall`` of their links, query by query, beams double. Links are verified as cosines in
double precision on the vectors as given. A link found from either side counts for both: they meet in a bitmap of
the two shards. Only counts per vector and spanning stars of the links leave a task; components are the union of
the stars.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
label, link with nothing and are kept; vectors of different length never meet; labels may be of any type that has a
text; float and double vectors are compared as given; repeated rows link with each other; repeated vec_ids are rows
of their own; rows with a null vec_id link like all others, and have the smallest vec_id of their component (null,
and kept, if it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.components import connected_components, local_labels
from orbitframe.llm.hnsw import Graph
from orbitframe.llm.settings import scratch, shuffle_partitions, written

SLACK = 1e-4  # float32 against double
PIECES = 64  # in which the vectors of a label are counted


@dataclass(frozen=True)
class Config:
    cosine: float = 0.93
    shard_rows: int = 16384
    block_rows: int = 512  # a multiple of 8
    beam: int = 32
    margin: float = 0.03
    audit_rows: int = 48
    audit_recall: float = 0.98


def wide(vectors: np.ndarray) -> np.ndarray:
    """In double precision; vectors whose squares would leave its range are scaled first."""
    out = vectors.astype(np.float64)
    size = np.abs(out).max(axis=1, keepdims=True)
    odd = (size > 1e100) | (size < 1e-100)
    return np.divide(out, size, where=odd, out=out) if odd.any() else out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = wide(vectors)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def build_shard(kind: str):
    """kind: the numpy type of the vectors' components."""

    def run(table: pa.Table) -> pa.Table:
        nodes, weights = table["node"].to_numpy(), table["weight"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(nodes), -1)[order].astype(kind)
        row = {c: table[c][0].as_py() for c in ("label", "dim", "shard", "shards")}
        row |= {"nodes": nodes[order].tobytes(), "weights": weights[order].tobytes(), "vectors": vectors.tobytes(), "graph": Graph.build(unit(vectors)).dumps()}
        return pa.Table.from_pylist([row], pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int64()), ("shards", pa.int64()), *((c, pa.binary()) for c in ("nodes", "weights", "vectors", "graph"))]))

    return run


class Shard:
    def __init__(self, row: dict, kind: str):
        self.nodes, self.weights = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.vectors = wide(np.frombuffer(row["vectors"], kind).reshape(len(self.nodes), -1))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.graph = Graph.loads(row["graph"], (self.vectors / self.norms[:, None]).astype(np.float32))


def search(queries: Shard, lo: int, hi: int, shard: Shard, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of verified links of queries lo..hi-1, with beams as wide as the audit asks for. None with itself."""
    q, least, beam, margin = queries.graph.vectors[lo:hi], config.cosine - SLACK, config.beam, config.margin
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), config.audit_rows)).astype(np.int64))
    truth = [np.flatnonzero(shard.graph.vectors @ q[i] >= least) for i in sample]
    if queries is shard:
        truth = [t[t != lo + i] for t, i in zip(truth, sample)]
    while True:
        a, b, _ = shard.graph.within(q, least, beam, margin)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        some = [(t, b[x:y]) for t, x, y in zip(truth, np.searchsorted(a, sample), np.searchsorted(a, sample, "right"), strict=True) if len(t)]
        recall = np.mean([np.isin(t, got).mean() for t, got in some]) if some else 1.0
        if recall >= config.audit_recall or beam >= 2 * len(shard.nodes):
            break
        beam, margin = 2 * beam, 2 * margin
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)] + lo, b[k : k + (1 << 16)]
        keep[k : k + (1 << 16)] = np.einsum("rd,rd->r", queries.vectors[x], shard.vectors[y]) / (queries.norms[x] * shard.norms[y]) >= config.cosine
        if queries is shard:
            keep[k : k + (1 << 16)] &= x != y
    return a[keep], b[keep]


def query_shards(config: Config, kind: str):
    """A pair of shards (or one, with itself): counts of links per node, and stars of linked nodes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["shard", "nodes", "weights", "vectors", "graph"]).to_pylist(), key=lambda r: r["shard"])
        first = Shard(rows[0], kind)
        other = Shard(rows[1], kind) if len(rows) > 1 else first
        m, n, step = len(first.nodes), len(other.nodes), config.block_rows
        met = np.zeros((m, -(-n // 8)), np.uint8)  # a bit per pair
        for lo in range(0, m, step):
            hi = min(m, lo + step)
            part = np.zeros((hi - lo, n), bool)
            part[search(first, lo, hi, other, config)] = True
            met[lo:hi] |= np.packbits(part, axis=1)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            if other is first:  # the same bits, seen from the other side
                part = np.unpackbits(met[lo:hi], axis=1, count=n).T
            else:
                part = np.zeros((m, hi - lo), np.uint8)
                b, a = search(other, lo, hi, first, config)
                part[a, b] = 1
            met[:, lo // 8 : -(-hi // 8)] |= np.packbits(part, axis=1)
        nodes = np.concatenate([first.nodes, other.nodes]) if other is not first else first.nodes
        shift = m if other is not first else 0
        links, label = np.zeros(len(nodes)), np.arange(len(nodes))
        for lo in range(0, m, step):
            part = np.unpackbits(met[lo : lo + step], axis=1, count=n)
            if not part.any():
                continue
            links[lo : lo + len(part)] += part @ other.weights.astype(np.float64)
            if shift:
                links[shift:] += first.weights[lo : lo + len(part)].astype(np.float64) @ part
            a, b = np.nonzero(part)
            a, b = label[a + lo], label[b + shift]
            apart = a != b
            if apart.any():
                ends, roots = local_labels(a[apart], b[apart])
                to = np.arange(len(nodes))
                to[ends] = roots
                label = to[label]
        some, star = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({
            "kind": np.repeat([0, 1], [len(some), len(star)]).astype(np.int32),
            "node": np.concatenate([nodes[some], nodes[star]]),
            "value": np.concatenate([links[some].astype(np.int64), nodes[label[star]]]),
        })

    return run


def link_embeddings(embeddings: DataFrame, config: Config = Config()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = embeddings.sparkSession
    at = scratch(spark, "embeddings")
    kind = "float" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "double"
    dtype = {"float": "f4", "double": "f8"}[kind]
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(ok, F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))))
    names = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "label", "vector")).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("*", *names)
    same = rows.filter("vector is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = written(same.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), f"{at}/reps")
    # Shards by hash, as many as a label needs; labels are counted in pieces, so that none is a hot key.
    pieced = reps.withColumn("piece", F.pmod("h2", F.lit(PIECES)))
    label = Window.partitionBy("label", "dim")
    sizes = pieced.groupBy("label", "dim", "piece").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.sum("n").over(label) / F.lit(float(config.shard_rows)))).drop("n")
    dealt = pieced.join(sizes, ["label", "dim", "piece"]).withColumn("shard", F.pmod("h1", "shards"))
    tasks = 4 * shuffle_partitions(spark)  # by work, not by bytes: graphs are small and searches long
    blobs = "nodes binary, weights binary, vectors binary, graph binary"
    built = dealt.select("label", "dim", "shard", "shards", "node", "weight", "vector").repartition(tasks, "label", "dim", "shard").groupBy("label", "dim", "shard").applyInArrow(build_shard(dtype), f"label string, dim int, shard long, shards long, {blobs}")
    graphs = written(built, f"{at}/graphs")
    paired = graphs.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("x", F.least("shard", "with")).withColumn("y", F.greatest("shard", "with"))
    found = written(paired.repartition(tasks, "label", "dim", "x", "y").groupBy("label", "dim", "x", "y").applyInArrow(query_shards(config, dtype), "kind int, node long, value long"), f"{at}/found")
    links = found.filter("kind = 0").groupBy("node").agg(F.sum("value").alias("links"))
    parts = connected_components(found.filter("kind = 1").select(F.col("node").alias("src"), F.col("value").alias("dst")))
    known = reps.select("h1", "h2", "node", "rep", "weight").join(links, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(smallest, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.lit(True).alias("known"))
    joined = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
