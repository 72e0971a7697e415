"""Rows that share an id or have none, through the stages that take rows out."""

import random

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def kept(spark, step, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND)
    return sorted(((r.doc_id, r.text) for r in step(spark, docs, SF).collect()), key=str)


def test_texts_that_share_an_id_stay(spark):
    x, y, z, u = (text(k) for k in range(4))
    rows = [(5, x), (5, y), (3, y), (5, z), (5, z), (None, u), (None, u), (None, x)]
    want = sorted([(5, x), (3, y), (5, z), (None, u)], key=str)
    assert kept(spark, cp.simhash_near_dedup, rows) == want


def test_each_row_is_judged_by_its_own_text(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = max(items, key=lambda t: len(t or ""))
    clean = text(7)
    rows = [(None, leak), (None, clean), (4, leak), (4, clean)]
    assert kept(spark, cp.benchmark_decontamination, rows) == sorted([(None, clean), (4, clean)], key=str)
