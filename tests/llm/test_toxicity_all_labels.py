"""The toxicity model learns from every labelled document, and its calibration is that of all rows."""

import numpy as np

from originflow.llm import labelled, toxicity


def test_every_labelled_document_counts(spark):
    n = 26_000  # more than 8,000 learning rows of each class
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('plain words w', id % 7) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    learned = labelled.learning_rows(labels, "toxic", 3, 1)
    assert {r["_label"]: r["count"] for r in learned.groupBy("_label").count().collect()}[0] > 8_000
    seen = []
    grown = toxicity.learn

    def spy(counted, *a):
        seen.append(counted.filter("prefix = 'plain\x03'").selectExpr(" + ".join(f"n{i}" for i in range(8))).first()[0])
        return grown(counted, *a)
    toxicity.learn = spy
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.learn = grown
    assert seen == [learned.count()]


def test_calibration_of_a_table(spark):
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=400))
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 3 * x))).astype(int)
    table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    assert np.allclose(labelled.fit_logistic_table(table), labelled.fit_logistic(x, y.astype(float)), atol=1e-4)
    assert labelled.fit_logistic_table(table.filter("y = 0")) == labelled.fit_logistic(np.zeros((y == 0).sum()), np.zeros((y == 0).sum()))
    assert labelled.fit_logistic_table(table.limit(0)) == (0.0, 0.0)
