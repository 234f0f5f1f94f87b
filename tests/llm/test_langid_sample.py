"""The sample that language ID learns from stays on the executors."""

import os

from pyspark.sql import functions as F

from orbitframe.llm import langid


def test_texts_of_the_sample_never_reach_the_driver(spark, monkeypatch):
    """Trained in a task: the same model as from the same rows here, while training in the driver's process is barred."""
    texts = [(i, ("der hund und die katze %d laufen" if i % 2 else "the dog and the cat %d are running") % i, ("de", "en")[i % 2 == 0]) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    config = langid.Config(epochs=1, windows=4, buckets_log2=10)
    want = langid.train([t for _, t, _ in texts], [y for *_, y in texts], config)
    driver, train = os.getpid(), langid.train

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(langid, "train", elsewhere)
    got = langid.fitted(docs, F.lit(False), config)
    assert got.labels == want.labels and abs(got.table - want.table).max() < 1e-4 and abs(got.temperature - want.temperature) < 0.5
    assert langid.fitted(docs.filter("lang IS NULL"), F.lit(False), config) is None
