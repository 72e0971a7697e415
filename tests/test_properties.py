"""Property tests: random inputs against plain-Python restatements."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import codemetrics as CM
from codeloom.operators.ranking import running_rank
from test_metrics import _bleu

WORDS = st.sampled_from(["def", "x", "return", "y", "(", ")", "if", "a", "b", "for", "in", "None"])
TEXT = st.lists(WORDS, min_size=0, max_size=12).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=8))
def test_ngram_scores_match_definition(spark, pairs):
    rows = [(i, r, c) for i, (r, c) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, reference string, candidate string")
    got = {r["id"]: r for r in CM.ngram_scores(df, ["id"]).collect()}
    for i, r, c in rows:
        assert abs(got[i]["ngram_match_score"] - _bleu(r, c)) < 1e-9
        assert abs(got[i]["weighted_ngram_match_score"] - _bleu(r, c, weighted=True)) < 1e-9


def test_running_rank_with_a_hot_group(spark):
    rng = random.Random(5)
    # one group holds most rows; order values are sparse and repeat
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randint(0, 5)}", rng.randint(0, 10 ** 6), i)
            for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    ranked = running_rank(df, ["g"], "x", width=1000, tiebreak=["id"])
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")))
    assert ranked.join(ref, ["g", "x", "id"]).filter(F.col("_rank") != F.col("rn")).count() == 0
    # the hot group is ranked in many (group, bucket) windows, not one
    assert df.filter("g = 'hot'").select(F.floor(F.col("x") / 1000)).distinct().count() > 100
