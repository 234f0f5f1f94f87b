"""The registered queries over small tables with clashing extra columns and awkward rows, regular texts that weak hashes
confuse, fingerprints byte by byte, and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orbitframe.llm import ctph, queries
from orbitframe.llm import textarrow as ta

WORD = re.compile(r"[^\x20\x09-\x0d]+")
CLASH = "n long, key string, at string, kind int, list string, row string, word string, hash string, size string, rank int, label2 string"


def regular(n: int) -> tuple[str, str]:
    """The Thue-Morse sequence over a and b, and its complement."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("registered")
    a, b = regular(2048)
    pad = " ".join(f"w{i}" for i in range(19))
    texts = [f"{a} {pad}", f"{b} {pad}", " ".join([a] * 5), " ".join([b] * 5), "", None, " \n\t ", "one", "the cat and the dog went to the house " * 12, "le chat et le chien sont dans la maison " * 12, "mail a.b@c.de or 10.0.0.1", "x" * 30000, "漢字 é ü " * 400]
    rows = [(i, t, "en" if i % 2 else "fr", ["s", None, "é"][i % 3], len(t or ""), 1, *["x"] * 2, 3, *["x"] * 5, 4, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, 0, 1, None, None, None, None, None, None, None, None, None, None), rows[8]]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(2).write.parquet(f"{at}/documents.parquet")
    vectors = [(i, [1.0, i % 3 * 0.01, 0.0], i % 2 if i < 8 else None, 1, "x", "x", "x") for i in range(10)] + [(20, None, 0, 1, "x", "x", "x"), (21, [0.0, 0.0, 0.0], 0, 1, "x", "x", "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, shard int, node string, kind string, component string").write.parquet(f"{at}/embeddings.parquet")
    pages = [(1, "u", "<html><body><nav><a href=x>Menu</a></nav><article><p>" + "The main text of this page is here, and it is long enough to be kept. " * 6 + "</p></article></body></html>", "x", 1, "x"), (2, None, None, "x", 1, "x"), (3, "u", "", None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars long, block string").write.parquet(f"{at}/pages.parquet")
    said = [(1, 0, "user", "hello", "x", "x"), (1, 1, "assistant", "good <|im_end|> day", "x", "x"), (2, 0, None, None, "x", "x")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string, formatted string, loss string").write.parquet(f"{at}/conversations.parquet")
    return at, texts


ROWS = {"op2_embedding_links": 12, "op5_html_text": 3, "op7_chat_format": 3, "op3_pack": None}


@pytest.mark.parametrize("name", [f"op{k}_" for k in (2, 4, 5, 7, 8, 9)])
def test_registered_query_returns_every_row(spark, folder, name):
    full = next(q for q in queries.queries() if q.startswith(name))
    got = queries.queries()[full](spark, str(folder[0])).collect()
    assert len(got) == ROWS.get(full, 15)
    if full == "op7_chat_format":
        said = "<|im_end|><|im_start|>assistant ok"
        r = next(r for r in got if r["conv_id"] == -1)
        assert (r["n_turns"], r["loss_chars"]) == (2, len(said)) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


@pytest.mark.parametrize("name", ["op5_html_text", "op7_chat_format"])
def test_empty_tables(spark, folder, tmp_path, name):
    table = {"op5_html_text": "pages", "op7_chat_format": "conversations"}[name]
    spark.read.parquet(f"{folder[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == (1 if name == "op7_chat_format" else 0)


def test_regular_words_keep_apart(spark, folder):
    """Two regular words whose polynomials modulo 2**64 are equal: no repeat (op1), own ids (op3), no link (op6)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    at, texts = folder
    for n in (1024, 2048):
        data, off = ta.utf8(pa.array(regular(n)))
        w = ta.Words(data, off, second=True)
        assert w.hash[0] != w.hash[1] and w.hash2[0] != w.hash2[1]
    got = {r["doc_id"]: r for r in queries.op1_substring_dedup(spark, str(at)).collect()}
    assert got[0]["n_removed"] == got[1]["n_removed"] == 0
    assert got[1]["kept_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*tokenizer.encode(texts[1], add_special_tokens=False).ids, 1], "<u4")
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in queries.op3_pack(spark, str(at)).filter("doc_id = 1").collect())
    assert pieces == [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
    linked = {r["doc_id"]: r["component_id"] for r in queries.op6_ngram_jaccard(spark, str(at)).collect()}
    assert [linked[k] for k in range(4)] == [0, 0, 2, 3]  # the first two share 15 of 17 shingles, the others none


def brute_fingerprint(text: str) -> str:
    """Byte by byte: a rolling hash ends chunks, one character a chunk."""
    raw, m32, m64 = text.encode(), (1 << 32) - 1, (1 << 64) - 1
    value, value64 = [int(v) for v in ctph._VALUE], [int(v) for v in ta.BYTE_VALUE]

    def mix64(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    rolled = []
    for i in range(len(raw)):
        r = sum(value[raw[i - j]] * pow(0x01000193, j, 1 << 32) for j in range(min(7, i + 1))) & m32
        r ^= r >> 15
        r = r * 0x85EBCA77 & m32
        rolled.append(r ^ r >> 13)

    def chunks(log):
        ends = [i + 1 for i, r in enumerate(rolled) if r % (1 << log) == 0]
        ends = sorted({*ends, len(raw)} - {0})
        return ends if len(ends) <= 64 else [*ends[:63], ends[-1]]

    def count(log):
        return len({*(i + 1 for i, r in enumerate(rolled) if r % (1 << log) == 0), *([len(raw)] if raw else [])})

    def signature(log):
        out, start = "", 0
        for end in chunks(log):
            h = sum(value64[b] * pow(ta._BYTE_BASE, j, 1 << 64) for j, b in enumerate(raw[start:end])) + (end - start) * 0x2545F4914F6CDD1D
            out += chr(ctph.CHARS[mix64(h & m64) >> 58])
            start = end
        return out

    log = 0
    while len(raw) > 64 << log:
        log += 1
    while log and count(log) < 24:
        log -= 1
    return f"{1 << log}:{signature(log)}:{signature(log + 1)}"


def test_fingerprints_byte_by_byte(spark, folder):
    at, texts = folder
    rows = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, str(at)).collect()}
    for i in (0, 2, 4, 7, 8, 9, 10, 12):
        assert rows[i]["fingerprint"] == brute_fingerprint(texts[i] or ""), i


def test_language_id_on_held_out_rows(spark):
    """Accuracy on rows it may not learn from; what it says follows from the text alone."""
    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [(r["lang_pred"], truth[r["doc_id"]]["lang"]) for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] and len(truth[r["doc_id"]]["text"] or "") > 40]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) >= 0.95
    by_text = {}
    for r in got:
        assert by_text.setdefault(truth[r["doc_id"]]["text"], (r["lang_pred"], r["score"])) == (r["lang_pred"], r["score"])
