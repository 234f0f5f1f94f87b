"""Mixing sources to target weights, by blocks.

Every source is read as one stream of words cut into blocks of a fixed length. A target in words per source
comes from weights, capped at ``max_repeat`` times the source (the excess is shared out again by weight); its
quota is the same share of its blocks.

1. Each output shard draws as many slots as it has, each slot a source with the quotas as weights: multinomial
   source counts. A source's counts are then scaled so that they sum to its quota, by scaling their running sums:
   what it drew too few or too many is spread over all shards as it drew them.
2. The counts are laid out as slots: shard s holds a run of its sources' slots. Slot i of a source with n blocks is
   slot i mod n of pass i div n, and a pseudorandom permutation of 0..n-1, keyed by source and pass (rounds of
   swap-or-not, a bijection for any n), maps it to a block.
3. Blocks of documents join slots by index. What the mixture takes of a document, and which shards it is in, follow
   from that join alone.

Only DataFrame functions are used, with integer arithmetic that SQL can state alike. Draws and slots are rows,
made where they are used. Streams are laid out with two-level prefix sums (source, salt), so that one source with
most of the rows is spread over ``SALTS`` groups. Nothing is broadcast by hint. Windows without a key run over
tables of one row a source only.

Defined cases: null text has size 0; null source is a source of its own, last in order; rows with the same
doc_id are separate rows; a source with few words takes part like all others; an empty table gives an empty
result; other columns are ignored by ``mix_sources`` and kept by ``mixed_texts``, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitframe.llm.settings import scratch, shuffle_partitions, written

WEIGHTS = (5, 2, 1)
SALTS, CELLS, SHARDS, ROUNDS, RUN = 256, 4096, 64, 16, 1 << 12
PRIME = (1 << 31) - 1
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def over(a: Column, b: Column | int) -> Column:
    """a div b of non-negative longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def noise(x: Column, k: Column | int) -> Column:
    """A number in 0..PRIME-1 for x >= 0 and a small k: two squarings modulo a prime."""
    k = F.lit(k).cast("long") if isinstance(k, int) else k
    y = ((x % PRIME) * 48271 + over(x, PRIME) * 69621 + k * 1299709 + 12345) % PRIME
    return ((y * y) % PRIME * 16807 + y * 7) % PRIME


def drawn(x: Column, k: int, n: Column) -> Column:
    """A number in 0..n-1 for x: noise twice over, so that n may be large."""
    return (noise(noise(x, k), k + 1) * PRIME + noise(noise(x, k + 2), k + 3)) % n


def targets(sizes: DataFrame, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """sizes(source, source_size) -> also source_rank, weight, target. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "source_rank")
    whole = Window.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(whole))
    )
    target = F.least(F.col("cap"), F.col("found.level") * F.col("weight"))
    return w.select("source", "source_rank", "weight", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """Also n_blocks, quota, and the quotas of all sources up to this one and in all."""
    n = F.ceil(F.col("source_size") / F.lit(float(block)))
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("n_blocks") + 0.5)).otherwise(0).cast("long")
    upto = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    with_quota = sources.withColumn("n_blocks", n).withColumn("quota", share)
    return with_quota.withColumn("upto", F.sum("quota").over(upto)).withColumn("all", F.sum("quota").over(Window.partitionBy()))


def shard_counts(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, source_rank, n_blocks, from, upto): the slots from..upto-1 of a source are in this shard."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n")).first()["n"]
    cell = lambda x: over(x * CELLS, F.lit(max(n, 1)))
    lo = F.col("upto") - F.col("quota")
    held = sources.filter("quota > 0").select("source_rank", lo.alias("lo"), F.col("upto").alias("hi"), F.explode(F.sequence(cell(lo), cell(F.col("upto") - 1))).alias("cell"))
    # Columns known not to be null keep the optimizer from restating all of this in a filter; steps of their own keep it compiled.
    known = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    draws = spark.range(n).withColumn("a", known(noise(F.col("id"), 1))).withColumn("b", known(noise(F.col("id"), 3)))
    draws = draws.withColumn("c", known(noise(F.col("a"), 2))).withColumn("d", known(noise(F.col("b"), 4)))
    draws = draws.withColumn("u", known((F.col("c") * PRIME + F.col("d")) % max(n, 1)))  # drawn(id, 1, n)
    draws = draws.select(known(over(F.col("id") * shards, max(n, 1))).alias("shard"), "u", known(cell(F.col("u"))).alias("cell"))
    drew = draws.join(held, "cell").filter("u >= lo and u < hi").groupBy("shard", "source_rank").agg(F.count(F.lit(1)).alias("drew"))
    each = sources.filter("quota > 0").select("source_rank", "n_blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    sofar = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        each.join(drew, ["shard", "source_rank"], "left").fillna(0, ["drew"])
        .withColumn("sum", F.sum("drew").over(sofar)).withColumn("total", F.sum("drew").over(Window.partitionBy("source_rank")))
        # a source that drew nothing at all is dealt evenly
        .withColumn("sum", F.when(F.col("total") > 0, F.col("sum")).otherwise(F.col("shard") + 1)).withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(shards))
        .withColumn("upto", F.expr("(cast(quota as decimal(19,0)) * cast(sum as decimal(19,0))) div cast(total as decimal(19,0))").cast("long"))
    )
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source_rank").orderBy("shard")), F.lit(0).cast("long"))
    return summed.select("shard", "source_rank", "n_blocks", before.alias("from"), "upto").filter("upto > from")


def permuted(x: Column, n: Column, steps: Column) -> Column:
    """Where x of 0..n-1 goes: in each step, x and k - x (mod n) change places or not, as both of them and m tell."""

    def swap_or_not(at: Column, step: Column) -> Column:
        other = F.pmod(step["k"] - at, n)
        return F.when(F.greatest(at, other) % PRIME * step["m"] % PRIME % 64 < 32, other).otherwise(at)

    return F.coalesce(F.aggregate(steps, x, swap_or_not), F.lit(0).cast("long"))  # never null, and known not to be


def laid_slots(counts: DataFrame) -> DataFrame:
    """(shard, source_rank, slot, index): the slots the shards drew, and the block each one takes."""
    n = F.col("n_blocks")
    runs = counts.select("*", F.explode(F.sequence("from", F.col("upto") - 1, F.lit(RUN).cast("long"))).alias("lo"))
    runs = runs.withColumn("hi", F.least(F.col("lo") + RUN, "upto")).repartition(4 * shuffle_partitions(counts.sparkSession), "source_rank", "lo")
    # a run may reach over the end of a pass; steps are those of a source and pass
    runs = runs.withColumn("pass", F.explode(F.sequence(over(F.col("lo"), n), over(F.col("hi") - 1, n))))
    named = lambda r: (F.col("source_rank") * 1024 + F.col("pass")) * ROUNDS + r
    steps = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), lambda r: F.struct(drawn(named(r), 5, n).alias("k"), (noise(noise(named(r), 9), 10) + 1).alias("m")))
    runs = runs.withColumn("steps", steps)
    slots = runs.withColumn("slot", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("pass") * n), F.least(F.col("hi"), (F.col("pass") + 1) * n) - 1)))
    return slots.select("shard", "source_rank", "slot", permuted(F.col("slot") % n, n, F.col("steps")).alias("index"))


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that name a row by what it holds; rows that share them are equal."""
    quoted = [(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in docs.schema.fields]
    held = [F.to_json(F.struct(c.alias("c"))) if has_map(kind) else c for c, kind in quoted]
    return [F.xxhash64(F.lit(k), *held).alias(f"k{k}") for k in (1, 2)]


class Mixture:
    """The plan of one mixture: ``sources``, ``counts`` (per shard), ``slots`` (with their blocks), ``rows`` (per document) and ``pieces`` (blocks of a document)."""

    def __init__(self, docs: DataFrame, block: int = 64, share: float = 1.5, max_repeat: int = 2, shards: int = SHARDS):
        spark = docs.sparkSession
        at = scratch(spark, "mixing")
        self.block = block
        sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row_keys(docs)), f"{at}/sized")
        salt = F.pmod(F.coalesce(F.col("doc_id").cast("long"), -1 - F.col("size")), F.lit(PRIME)) * 48271 % PRIME % SALTS
        salted = sized.withColumn("salt", salt)
        parts = salted.groupBy("source", "salt").agg(F.sum("size").alias("part_size"))
        before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.select(F.col("source").alias("s"), F.col("salt").alias("t"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"))
        sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
        self.sources = written(quotas(targets(sizes, share, max_repeat), block), f"{at}/sources")
        self.counts = written(shard_counts(self.sources, shards), f"{at}/counts")
        self.slots = laid_slots(self.counts)
        within = Window.partitionBy("source", "salt").orderBy("doc_id", "size", "k1").rowsBetween(Window.unboundedPreceding, 0)
        laid = salted.withColumn("upto", F.sum("size").over(within))
        laid = laid.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t")))
        laid = laid.withColumn("begin", F.col("offset") + F.col("upto") - F.col("size")).drop("s", "t", "salt", "upto", "offset")
        src = self.sources.select(F.col("source").alias("s"), "source_rank", "source_size", "target")
        self.rows = laid.join(src, laid["source"].eqNullSafe(src["s"])).drop("s")

    def pieces(self) -> DataFrame:
        """One row per (document, block) overlap: its words, how often the mixture takes them, and the first and last shard that do."""
        b = F.lit(self.block).cast("long")
        taken = self.slots.groupBy("source_rank", "index").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
        return (
            self.rows.filter("size > 0")
            .withColumn("index", F.explode(F.sequence(over(F.col("begin"), b), over(F.col("begin") + F.col("size") - 1, b))))
            .withColumn("words", F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * b) - F.greatest(F.col("begin"), F.col("index") * b))
            .join(taken.hint("shuffle_hash"), ["source_rank", "index"], "left").fillna(0, ["times"])
        )

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, first_shard, last_shard (-1 if nothing is taken). A document with words is known by its source and where it begins there."""
        columns, none = ["doc_id", "size", "source_size", "target"], F.lit(-1).cast("long")
        took = F.sum(F.col("words") * F.col("times")).cast("long").alias("taken")
        taken = self.pieces().groupBy("source_rank", "begin", *columns).agg(took, F.coalesce(F.min("first_shard"), none).alias("first_shard"), F.coalesce(F.max("last_shard"), none).alias("last_shard"))
        empty = self.rows.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), none.alias("first_shard"), none.alias("last_shard"))
        return taken.select(*empty.columns).unionByName(empty)


def mix_sources(docs: DataFrame, block: int = 64, share: float = 1.5, max_repeat: int = 2, shards: int = SHARDS) -> DataFrame:
    return Mixture(docs, block, share, max_repeat, shards).documents()


def mixed_texts(docs: DataFrame, block: int = 64, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """The mixture itself: per document and pass one row with the words taken; all columns of docs stay.

    A document taken whole keeps its text as it is; else its taken words, in order, are joined by one space.
    Documents without words are not part of a mixture.
    """
    m = Mixture(docs, block, share, max_repeat)
    times = F.transform(F.sort_array(F.collect_list(F.struct("index", "times"))), lambda x: x["times"])
    taken = m.pieces().groupBy("k1", "k2", "begin").agg(times.alias("times"))
    passes = taken.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("times"))))
    passes = passes.filter("pass >= 1 and array_max(times) >= pass")
    wide = docs.select(F.struct("*").alias("row"), *row_keys(docs)).dropDuplicates(["k1", "k2"])  # of equal rows, begin tells how many there are
    joined = wide.join(passes, ["k1", "k2"])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    skipped = F.col("begin") % block  # words of its first block that are other documents'
    kept = F.filter(words, lambda _, i: F.element_at(F.col("times"), (over(skipped + i, block) + 1).cast("int")) >= F.col("pass"))
    text = F.when(F.array_min("times") >= F.col("pass"), F.col("row.text")).otherwise(F.array_join(kept, " "))
    own = lambda c: F.col("row").getField(c).alias(c)
    return joined.withColumn("text", text).select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else own(c) for c in docs.columns])
