"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.ctph import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.chat import format_digests

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.embeddings import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op9_mix_sources": MIX, "op12_source_divergence": DIVERGENCE, "op13_spelling_variants": SPELLING}


def _noise(x: str, k: str) -> str:
    """A macro: a number in 0..2147483646 for x >= 0, by two squarings modulo that prime."""
    y = f"((({x}) % 2147483647 * 48271 + ({x}) // 2147483647 * 69621 + ({k}) * 1299709 + 12345) % 2147483647)"
    return f"(({y} * {y} % 2147483647 * 16807 + {y} * 7) % 2147483647)"


def _drawn(x: str, k: int, n: str) -> str:
    """A macro: a number in 0..n-1 for x."""
    return f"(({_noise(_noise(x, str(k)), str(k + 1))} * 2147483647 + {_noise(_noise(x, str(k + 2)), str(k + 3))}) % {n})"


MIX = f"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sizes),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(source_rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
leveled AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER () * 1.5::DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (
  SELECT *, least(cap, (SELECT arg_min(level, ratio) FROM leveled WHERE level <= ratio) * weight)::DOUBLE AS target FROM leveled),
planned AS (
  SELECT *, ceil(source_size / 64.0::DOUBLE)::BIGINT AS n,
    CASE WHEN source_size > 0 THEN floor(target / source_size * ceil(source_size / 64.0::DOUBLE)::BIGINT + 0.5::DOUBLE) ELSE 0 END::BIGINT AS quota FROM aimed),
ends AS (SELECT *, (sum(quota) OVER (ORDER BY source_rank))::BIGINT AS upto, (sum(quota) OVER ())::BIGINT AS total FROM planned),
ids AS (SELECT unnest(range((SELECT max(total) FROM ends))) AS id, (SELECT max(total) FROM ends) AS total),
draws AS (SELECT id * 64 // total AS shard, {_drawn("id", 1, "total")} AS u FROM ids),
drew AS (SELECT shard, source_rank, count(*) AS drew FROM draws JOIN ends ON u >= upto - quota AND u < upto GROUP BY ALL),
summed AS (
  SELECT e.source_rank, n, quota, s.shard, sum(coalesce(drew, 0)) OVER (PARTITION BY e.source_rank ORDER BY s.shard) AS so_far, sum(coalesce(drew, 0)) OVER (PARTITION BY e.source_rank) AS drew_all
  FROM ends e CROSS JOIN (SELECT unnest(range(64)) AS shard) s LEFT JOIN drew d ON d.source_rank = e.source_rank AND d.shard = s.shard WHERE quota > 0),
scaled AS (SELECT *, CASE WHEN drew_all > 0 THEN quota::HUGEINT * so_far // drew_all ELSE quota::HUGEINT * (shard + 1) // 64 END::BIGINT AS upto FROM summed),
counts AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY source_rank ORDER BY shard), 0) AS begins FROM scaled),
slots AS (SELECT source_rank, n, shard, unnest(range(begins, upto)) AS slot FROM counts),
passes AS (
  SELECT source_rank, pass, list_transform(range(1, 17), lambda r: {_drawn("(source_rank * 1024 + pass) * 16 + r", 5, "n")}) AS k,
    list_transform(range(1, 17), lambda r: {_noise(_noise("(source_rank * 1024 + pass) * 16 + r", "9"), "10")} + 1) AS m
  FROM (SELECT DISTINCT source_rank, n, slot // n AS pass FROM slots)),
mapped AS (
  SELECT source_rank, shard, list_reduce(range(1, 17), lambda x, r:
      CASE WHEN greatest(x, ((k[r] - x) % n + n) % n) % 2147483647 * m[r] % 2147483647 % 64 < 32 THEN ((k[r] - x) % n + n) % n ELSE x END, slot % n) AS index
  FROM slots JOIN passes p USING (source_rank) WHERE p.pass = slot // n),
blocks AS (SELECT source_rank, index, count(*) AS times, min(shard) AS first_shard, max(shard) AS last_shard FROM mapped GROUP BY ALL),
laid AS (
  SELECT s.*, p.source_size, p.target, p.source_rank,
    (sum(size) OVER (PARTITION BY s.source ORDER BY ((coalesce(doc_id, -1 - size) % 2147483647) + 2147483647) % 2147483647 * 48271 % 2147483647 % 256, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
pieces AS (SELECT *, unnest(range(first // 64, CASE WHEN size > 0 THEN (first + size - 1) // 64 + 1 ELSE first // 64 END)) AS index FROM laid),
took AS (
  SELECT row, sum((least(first + size, (p.index + 1) * 64) - greatest(first, p.index * 64)) * times)::BIGINT AS taken, min(first_shard)::BIGINT AS first_shard, max(last_shard)::BIGINT AS last_shard
  FROM pieces p JOIN blocks b ON b.source_rank = p.source_rank AND b.index = p.index GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_shard, -1) AS first_shard, coalesce(last_shard, -1) AS last_shard FROM laid LEFT JOIN took USING (row)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _weight(n: str, total: str, v: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + {v}))"


DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN langs l ON l.lang = g.lang),
weights AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_weight("coalesce(c.n, 0)", "g.total", "g.v")} AS p, {_weight("k.n", "g.lang_total", "g.v")} AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM weights WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# The checksum bit by bit: a table of 256 entries, then the bytes of id and run, which are ASCII or U+00C0 to U+00FF.
SPELLING = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
times AS (SELECT doc, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (SELECT doc, run, times, flatten(list_transform(range(1, len(doc) + len(run) + 2), lambda i:
  CASE WHEN unicode(substr(doc || ':' || run, i, 1)) < 128 THEN [unicode(substr(doc || ':' || run, i, 1))] ELSE [195, unicode(substr(doc || ':' || run, i, 1)) - 64] END)) AS b FROM times),
hashed AS (SELECT doc, run, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::INT]), 4294967295::BIGINT)) AS h FROM bytes, crc),
slipped AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE len(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'minus': -w.n, 'form': b}}) AS best FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.minus >= 10 * n THEN best.form END AS form, (CASE WHEN -best.minus >= 10 * n THEN -best.minus END)::BIGINT AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS further FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.further)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.further IS NULL
"""
