"""The index of window fingerprints over deliveries: equal to one pass over all, whatever happens in between."""

import random

import pytest

from orbitframe.llm import settings, substring

DOCS = "doc_id long, text string"


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(45) for _ in range(4)]
    texts = []
    for i in range(60):
        body = [say(rng.randrange(0, 90))]
        if i % 2:
            body.append(passages[i % 4 if i < 40 else rng.randrange(4)])
        if i in (33, 51):
            body += [texts[3], texts[20] or "", body[0]]
        texts.append(" ".join([*body, say(rng.randrange(0, 30))]))
    texts[10], texts[31], texts[50] = None, "", texts[7]
    return [(None, passages[0])] + list(enumerate(texts))


def kept(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("cuts", [(20,), (1, 2, 15, 30, 31, 48)])
def test_deliveries_equal_one_pass(spark, tmp_path, cuts):
    rows = corpus()
    whole = kept(substring.dedup_substrings(spark.createDataFrame(rows, DOCS), with_text=True))
    assert sum(r[1] for r in whole.values()) > 1000
    got, at = {}, f"file://{tmp_path}/index"
    for a, b in zip((0, *cuts), (*cuts, len(rows))):
        index = substring.FingerprintIndex.opened(spark, at)  # nothing is kept in memory from delivery to delivery
        batch, before = spark.createDataFrame(rows[a:b], DOCS), spark.createDataFrame(rows[:a], DOCS) if a else None
        got |= kept(index.deliver(batch.repartition(3), before, with_text=True))
        assert len(index.runs) <= index.fanout
    assert got == whole
    left = settings.matching(spark, f"{at}/run-*")
    assert sorted(p.rsplit("/", 1)[1] for p in left) == sorted(p.rsplit("/", 1)[1] for p in index.runs)
    assert len(settings.matching(spark, f"{at}/manifest-*")) == 1


def test_delivery_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    rows, at = corpus(), f"file://{tmp_path}/index"
    whole = kept(substring.dedup_substrings(spark.createDataFrame(rows, DOCS)))
    parts = [rows[:20], rows[20:40], rows[40:45], rows[45:]]
    df = lambda r: spark.createDataFrame(r, DOCS)
    got = kept(substring.FingerprintIndex.opened(spark, at).deliver(df(parts[0])))
    for i in (1, 2, 3):
        before = [r for p in parts[:i] for r in p]
        with monkeypatch.context() as m:
            m.setattr(substring.FingerprintIndex, "commit", lambda self: 1 / 0)  # dies once its runs are there, or have been merged
            with pytest.raises(ZeroDivisionError):
                substring.FingerprintIndex.opened(spark, at).deliver(df(parts[i]), df(before))
        got |= kept(substring.FingerprintIndex.opened(spark, at).deliver(df(parts[i]), df(before)))
    assert got == whole


def test_deliveries_defined_cases(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    df = lambda r: spark.createDataFrame(r, DOCS)
    index = substring.FingerprintIndex.opened(spark, at)
    assert kept(index.deliver(df([]))) == {}
    text = " ".join(map(str, range(40)))
    first = df([(5, text), (6, None)])
    assert {k: v[1] for k, v in kept(index.deliver(first)).items()} == {5: 0, 6: 0}
    assert kept(index.deliver(df([]), first)) == {}
    with pytest.raises(ValueError, match="greater than 6"):
        index.deliver(df([(6, text)]), first)
    with pytest.raises(ValueError, match="earlier deliveries"):
        index.deliver(df([(7, text)]))
    with pytest.raises(ValueError, match="20 words"):
        substring.FingerprintIndex.opened(spark, at, width=10)
    assert {k: v[1] for k, v in kept(index.deliver(df([(7, text), (7, text), (8, "a " + text)]), first)).items()} == {7: 40, 8: 40}
