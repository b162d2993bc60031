"""Quality models are made of all training documents."""

import random

from loam.llm import quality


def test_training_reads_every_trusted_document(spark, monkeypatch):
    """A bound of two sampled documents, as there was one, changes nothing."""
    r = random.Random(4)
    rows = [(i, "en", " ".join(r.choice(["stone", "river", "light", "garden", "winter"]) + str(r.randint(0, 9)) for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    every = {x.doc_id: round(x.perplexity, 9) for x in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "SAMPLE", 1, raising=False)
    assert {x.doc_id: round(x.perplexity, 9) for x in quality.classify(docs, labels).collect()} == every
