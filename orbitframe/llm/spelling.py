"""Grouping spelling variants: words one inserted, deleted or replaced code point apart.

Rare-first prefix filter. One edit breaks at most two of a word's bigrams, so of the three rarest bigrams of two near
words (one order for all words) at least one is common to both, shifted by at most one place. An edit leaves a
common bigram whole, so it lies behind it or before it: the words agree from their start up to the bigram, or from
the bigram to their end. The join is on that: the rare bigram, its place from the start (or from the end), the
text on that side, and the half of the other side that the edit leaves alone, halves being those of the
shorter word. Keys carry the lengths, so a word meets words of its own length and of one more. Candidates
are verified by edit distance; a key is a hash, which can only add candidates.

The table of bigram frequencies has at most 90 x 90 rows, the letters a word may hold; it alone is small by
construction. All else is joined by key: no list of words that share a bigram is ever built.

Defined cases: null text has no words; a null doc_id reads as an empty id; ties of frequency go by bigram, then
place; ties of n go to the smallest word; repeated rows count again; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.settings import remove, scratch, written

RUN, LEAST_LENGTH, LEAST_N, TIMES, SLIP = "[A-Za-z\\u00C0-\\u00FF]", 7, 2, 10, 31
GRAM, RAREST = 2, 3  # one edit breaks GRAM bigrams at most, so GRAM + 1 are enough


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n). Runs too short to give a word are never cut out; one code point of some runs is left out, by a hash."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("long"))
    cut = (F.col("h") % F.col("long")).cast("int")
    word = F.when(F.col("h") % SLIP == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.col("long")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_N)


def rarest(words: DataFrame) -> DataFrame:
    """(word, long, place): places (from 0) of the three rarest bigrams of each word."""
    places = F.expr("sequence(0, length(word) - 2)")
    grams = words.select("word", F.explode(places).alias("place")).select("word", "place", F.expr(f"substring(word, place + 1, {GRAM})").alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rare = grams.join(F.broadcast(counted), "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "place"))), 1, RAREST).alias("rare"))
    return rare.select("word", F.length("word").alias("long"), F.explode("rare.place").alias("place"))


def keyed(rare: DataFrame) -> DataFrame:
    """(role, key, word): role 0 meets role 0 (words of one length), role 1 meets role 2 (a word and one a code point longer)."""
    short = F.expr("transform(array(0, 1, 2), role -> struct(role, IF(role = 2, long - 1, long) AS short))")
    r = rare.select("word", "long", "place", F.explode(short).alias("r")).select("word", "long", "place", "r.role", "r.short")
    lengths = F.expr("struct(IF(role = 0, 0, 1) AS kind, short)")
    # The edit is behind the bigram: the start agrees up to its end. What follows has `rest` code points in the shorter word.
    behind = r.withColumn("rest", F.expr(f"short - place - {GRAM}")).filter("rest >= 0").withColumn("half", F.expr("rest div 2"))
    start = f"substring(word, 1, place + {GRAM})"
    behind = behind.select("role", "word", F.explode(F.array(
        F.xxhash64(F.lit("b0"), lengths, "place", F.expr(start), F.expr(f"substring(word, place + {GRAM + 1}, half)")),
        F.xxhash64(F.lit("b1"), lengths, "place", F.expr(start), F.expr("substring(word, long - (rest - half) + 1, rest - half)")))).alias("key"))
    # The edit is before the bigram: the end agrees from its start on. Its place is counted from the end.
    before = r.withColumn("tail", F.expr("long - place")).withColumn("rest", F.expr("short - tail")).filter("rest >= 0").withColumn("half", F.expr("rest div 2"))
    end = "substring(word, place + 1, tail)"
    before = before.select("role", "word", F.explode(F.array(
        F.xxhash64(F.lit("f0"), lengths, "tail", F.expr(end), F.expr("substring(word, 1, half)")),
        F.xxhash64(F.lit("f1"), lengths, "tail", F.expr(end), F.expr("substring(word, place - (rest - half) + 1, rest - half)")))).alias("key"))
    return behind.unionByName(before)


def near_pairs(words: DataFrame, at: str) -> DataFrame:
    """(a, b): each unordered pair of near words, once."""
    keys = written(keyed(rarest(words)), f"{at}/keys")
    same, short, more = (keys.filter(F.col("role") == k) for k in range(3))
    equal = same.select("key", F.col("word").alias("a")).join(same.select("key", F.col("word").alias("b")), "key").filter("a < b")
    longer = short.select("key", F.col("word").alias("a")).join(more.select("key", F.col("word").alias("b")), "key")
    return equal.unionByName(longer).select("a", "b").filter(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame, at: str) -> DataFrame:
    """(word, root) for words that have a form. Forms grow tenfold in n, so paths are short; each round doubles what is followed."""
    spark = forms.sparkSession
    now, k = written(forms.select("word", F.col("form").alias("root")), f"{at}/0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        now = written(step, f"{at}/{k}")
        moved = now.filter("moved").limit(1).count()
        remove(spark, f"{at}/{k - 1}")
        now = now.drop("moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word."""
    at = scratch(docs.sparkSession, "spelling")
    words = written(words_of(docs), f"{at}/words")
    pairs = written(near_pairs(words, at), f"{at}/pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("other")), "b")
    # The near word of largest n, the smallest of these: the least (-n, word).
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("takes", F.coalesce(-F.col("best.minus") >= F.col("n") * TIMES, F.lit(False)))
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("takes"), F.col("best.form")).alias("form"), F.when(F.col("takes"), -F.col("best.minus")).alias("form_n")), f"{at}/forms")
    root = roots(joined.filter("form IS NOT NULL"), f"{at}/roots")
    out = joined.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), *(F.col(c).cast("long").alias(c) for c in ("n", "n_near", "form_n")))
