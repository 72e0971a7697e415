"""Tables whose links are rare: the audit counts links before it trusts the rounds."""

import numpy as np
import pytest

from codeloom.llm import embedding_dedup
from test_embedding_dedup import brute, got


@pytest.fixture(scope="module")
def sparse():
    """1,500 random vectors of one label and 40 isolated pairs among them."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 48))
    x[:40] = x[40:80] + 0.3 * rng.standard_normal((40, 48))
    return [(k, v.tolist(), 1) for k, v in enumerate(x)]


def test_no_link_in_the_first_nodes_is_not_recall_one(spark, sparse, monkeypatch):
    seen = []
    audit = embedding_dedup._audit
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *a: seen.append(audit(*a)) or seen[-1])
    df = spark.createDataFrame(sparse, "vec_id long, embedding array<double>, label int")
    have = got(embedding_dedup.near_duplicates(df, k=2, projections=1, rounds=1, most_rounds=1, queries=10))
    want = brute(sparse)
    assert sum(n for n, _ in want.values()) > 60
    assert seen[0] < 0.9  # one round over one projection finds few of the isolated pairs
    assert set(have) == set(want)


def test_what_the_rounds_miss_is_compared_exactly(spark, sparse):
    df = spark.createDataFrame(sparse, "vec_id long, embedding array<double>, label int")
    have = got(embedding_dedup.near_duplicates(df, k=2, projections=1, rounds=1, most_rounds=1, block=400))
    assert {i: v[:2] for i, v in have.items()} == brute(sparse)
