"""Piece encoding, source divergence and spelling variants: the registered queries against a library, brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import divergence, pieces, queries, spelling

# Extra columns clash with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, ids string, word string, shard string, part string"
WORDS = "government governments goverment governmant house houses housed mountain mountains maintain Straße straßen élève élèves river rivers rivet the of and".split()


def corpus():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices(WORDS, [30, 2, 2, 1, 9, 3, 1, 40, 3, 3, 5, 5, 6, 4, 7, 3, 2, 50, 40, 30], k=n))
    texts = [say(rng.randrange(5, 90)) for _ in range(60)]
    texts += [texts[3]] * 3 + ["", " ", "   \n\t", None, "x", "Zürich ZÜRICH zürich", "漢字 漢字 😀 a▁b  c", "a\x00b\r\n<s></s><0x41>", "e" * 5000, "= " * 300, " " * 500 + "end", "ab" * 20000]
    texts += [say(4000), "governmentgovernment " * 40, "Mountain MOUNTAIN mountaiN mountain's 7mountain8", "×÷×÷×÷×÷ ×÷×÷×÷×÷ ×÷×÷×÷×÷"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["web", "web", "web", "news", None, "Web", "é"][i % 7], 1, "t", "i", "w", "s", "p") for i, t in enumerate(texts)]
    rows += [(None, say(40), "en", "web", 1, None, None, None, None, None)] * 2 + [(5, say(40), "en", "only", 1, "", "", "", "", "")] + [(900, None, "xx", f"s{k}", 1, "", "", "", "", "") for k in range(3)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with a documents table: the corpus, and an empty one."""
    at = tmp_path_factory.mktemp("new")
    for name, rows in (("full", corpus()), ("empty", [])):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/{name}/documents.parquet")
    return at


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_piece_query_equals_the_library(spark, tables, library):
    want = []
    for r in corpus():
        ids = [*library.encode(r[1] or ""), library.eos_id()]
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in queries.op11_piece_encoding(spark, f"{tables}/full").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert queries.op11_piece_encoding(spark, f"{tables}/empty").count() == 0


def test_prefix_table_on_random_strings(library):
    rng = random.Random(3)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    texts = ["".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["".join(rng.choices(letters, k=rng.randrange(50))) for letters in ("aeinrst", "= -*_▁", "abcñß漢字😀 \x00\n\t") for _ in range(2000)]
    texts += [c * k for c in "e =-" for k in range(70)]
    table = pieces.pieces_of(pieces.MODEL)
    data, off = pieces.ta.utf8(pieces.marked(pieces.pa.array(texts)))
    ids, at = table.encode(data, off)
    want = library.encode(texts)
    assert all(ids[at[k] : at[k + 1]].tolist() == w for k, w in enumerate(want))
    assert [t.decode() for t in table.decode(ids, at)] == [library.decode(w) for w in want]


def test_decoding_ids_that_no_text_gives(spark, library):
    rng = random.Random(5)
    lists = [[rng.choice((rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randrange(9))] for _ in range(5000)]
    off = np.append(0, np.cumsum([len(x) for x in lists]))
    got = pieces.pieces_of(pieces.MODEL).decode(np.array([i for x in lists for i in x], np.int32), off)
    assert [t.decode() for t in got] == [library.decode(x) for x in lists]
    rows = spark.createDataFrame([(1, [2, 259, 1]), (None, []), (3, None), (1, [2, 259, 1])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode_documents(rows).select("doc_id", "text").collect()), key=str) == sorted([(1, " "), (None, ""), (3, ""), (1, " ")], key=str)


def brute_divergence(rows):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        terms = [t.translate(low) for t in term.findall(r[1] or "")]
        counts[r[2] or "", r[3] or ""].update(terms)
        df[r[2] or ""].update(set(terms))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= 3]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: weigh(c) for s, c in groups.items()}, weigh(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_query_equals_brute_force(spark, tables):
    want = brute_divergence(corpus())
    got = queries.op12_source_divergence(spark, f"{tables}/full").select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == want and {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert queries.op12_source_divergence(spark, f"{tables}/empty").count() == 0


def test_divergence_over_many_blocks_and_shards(spark, monkeypatch):
    """With blocks of 2 and shards of 4 terms every pair still meets once."""
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SHARD_TERMS", 4)
    rng = random.Random(2)
    for sources in (1, 2, 5, 8, 11):
        rows = [(i, " ".join(rng.choices(WORDS, k=30)), "en", f"s{i % sources:02}") for i in range(sources * 4)]
        got = divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == brute_divergence(rows)


def test_weights_are_exact_for_huge_counts():
    n = np.array([0, 5, 10**13, 9 * 10**15], np.int64)
    total, v = 9 * 10**15 + 10**13 + 5, 7
    assert divergence.weight(n, total, v).tolist() == [1 + 10**9 * (int(x) + 1) // (total + v) for x in n]


def test_every_two_blocks_meet_once(spark):
    for blocks in range(1, 12):
        rows = spark.range(blocks).select(F.col("id").alias("block"), F.lit(blocks).alias("blocks")).select("block", F.explode(divergence.visits("blocks", "block")).alias("to")).collect()
        met = Counter(frozenset((r["block"], r["to"]["host"])) for r in rows)
        assert len(met) == blocks * (blocks + 1) // 2 and set(met.values()) == {1}


def brute_spelling(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a != b and len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])

    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n.get(form[w])))
    return sorted(out)


def test_spelling_query_equals_brute_force(spark, tables):
    want = brute_spelling(corpus())
    got = queries.op13_spelling_variants(spark, f"{tables}/full").select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == want and any(r[1] for r in want)
    assert queries.op13_spelling_variants(spark, f"{tables}/empty").count() == 0


def test_spelling_finds_every_near_pair(spark):
    """Words that repeat their letters, and all words one edit from a few: the hard case for a prefix filter. Paths of forms are followed."""
    rng = random.Random(11)
    words = Counter()
    for base in ("aaaaaaaa", "abababab", "abcabcab", "àbéçàbéç", "xyxyxxyy"):
        for _ in range(60):
            k, c = rng.randrange(len(base)), rng.choice("abxé")
            words[rng.choice((base, base[:k] + base[k + 1 :], base[:k] + c + base[k:], base[:k] + c + base[k + 1 :]))] += 2
    words |= Counter({"aaaaaaaab": 40, "aaaaaaabb": 400, "aaaaaabbb": 4000, "aaaaabbbb": 40000})
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(sorted(words.items()))]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_spelling(rows)
    assert sorted(map(tuple, got)) == want and any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_spelling_variants"])
def test_sql_says_the_same(spark, tables, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/full/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, f"{tables}/full").select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
