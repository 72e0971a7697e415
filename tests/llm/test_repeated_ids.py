"""Labels and documents that repeat their ids."""

import random

import numpy as np

from codeloom.llm import quality
from test_pipeline_rows import text


def test_sample_with_repeated_ids(spark):
    """Copies of one id neither fill the sample nor crowd out the texts of others."""
    rng = random.Random(1)
    some = [(k, text(rng.random(), 20)) for k in range(60)]
    marks = [(k, k % 2) for k in range(60)]
    once = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    many = spark.createDataFrame(some + some[:6] * 60, "doc_id long, text string"), spark.createDataFrame(marks * 3 + [(2, 1)], "doc_id long, quality int")
    for per_label in (5, 2000):
        x, y = quality._sample(*once, "doc_id", "text", "quality", per_label)
        a, b = quality._sample(*many, "doc_id", "text", "quality", per_label)
        assert np.array_equal(x, a) and np.array_equal(y, b)
        assert max(np.bincount(b)) <= per_label
