"""Each stage against a plain restatement, on the rows its predecessor kept."""

import corpus_pipeline as cp
import pytest
from codeloom.llm import quality
from codeloom.llm.staging import stage
import test_bpe
import test_decontaminate
import test_simhash
import test_substrings

SF = "/root/testdata/sf0.01"
known = test_bpe.known


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, step in cp.STAGES:
        out.append(stage(step(spark, out[-1], SF), name))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(kept):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    for df in kept[:-1]:
        assert df.columns == kept[0].columns and df.dtypes == kept[0].dtypes


def test_quality(spark, kept):
    scores = by_id(quality.score_quality(kept[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(by_id(kept[1])) == {i for i, r in scores.items() if r.score >= 0.5}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sum((r.doc_id in by_id(kept[1])) == (r.quality == 1) for r in labels) > 0.97 * len(labels)


def test_near_duplicates(kept):
    groups = test_simhash.brute([(i, r.text) for i, r in by_id(kept[1]).items()])
    assert by_id(kept[2]) == {i: r for i, r in by_id(kept[1]).items() if groups[i][1] == i}


def test_repeats(kept):
    rows = by_id(kept[2])
    want = {}
    for i, n, gone, left in test_substrings.brute([(i, r.text) for i, r in rows.items()]):
        if gone == 0:
            want[i] = rows[i].text, rows[i].n_chars
        elif gone < n:
            want[i] = left, len(left)
    assert {i: (r.text, r.n_chars) for i, r in by_id(kept[3]).items()} == want


def test_leaks(spark, kept):
    rows = by_id(kept[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in test_decontaminate.brute([(i, r.text) for i, r in rows.items()], items)}
    assert by_id(kept[4]) == {i: r for i, r in rows.items() if i not in leaks}


def test_tokens(spark, kept, known):
    want = {i: test_bpe.digests(known, r.text) for i, r in by_id(kept[4]).items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept[5].collect()} == want
    assert {tuple(r) for r in cp.run(spark, SF).collect()} == {tuple(r) for r in kept[5].collect()}


def test_null_rows_and_empty_table(spark, kept):
    docs = spark.createDataFrame(
        [(None, "some words of a text without an id", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0),
         (3, "Plain words that nobody repeats, in a row.", "en", None, 42), (3, "Plain words that nobody repeats, in a row.", "en", None, 42)],
        kept[0].schema,
    )
    for name, step in cp.STAGES[1:]:
        docs = stage(step(spark, docs, SF), name)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]
    empty = kept[0].limit(0)
    for name, step in cp.STAGES:
        empty = stage(step(spark, empty, SF), name)
    assert empty.count() == 0


def test_run_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run
