"""Split, index, batches, pairs and triplets: properties on the fixtures."""

from pyspark.sql import functions as F

from codeloom.operators import sampling as S
from codeloom.plans.training import build_training_set
from codeloom.sources.tables import Tables
from conftest import SF_MID


def test_split_covers_packages_once_and_respects_share(spark):
    t = Tables(spark, SF_MID)
    sizes = S.package_sizes(t["node_docs"], t["edge_docs"])
    split = S.group_split(sizes, val=0.2, seed=7).collect()
    assert len(split) == len({r["package"] for r in split}) == 20
    S.check_split(S.group_split(sizes, val=0.2, seed=7))
    total = sum(r["n"] for r in split)
    train = sorted((r["order_key"], r["package"], r["n"]) for r in split if r["split"] == "train")
    # train is a prefix of the shuffled order and crosses 80 % with its last package
    assert sum(n for _, _, n in train) >= 0.8 * total
    assert sum(n for _, _, n in train[:-1]) < 0.8 * total


def test_split_raises_when_a_side_is_empty(spark):
    sizes = spark.createDataFrame([("a", 0, 10)], "package string, nodes long, edges long")
    try:
        S.check_split(S.group_split(sizes, val=0.2))
    except ValueError as e:
        assert "validation" in str(e)
    else:
        raise AssertionError("expected an error")


def test_merged_index_is_a_permutation(spark):
    t = Tables(spark, SF_MID)
    split = S.group_split(S.package_sizes(t["node_docs"], t["edge_docs"]))
    idx = S.merged_index(t["edge_docs"].select("package", "edge_id"), split, "edge_id")
    vals = sorted(r["global_idx"] for r in idx.collect())
    assert vals == list(range(1000))


def test_triplets_count_and_same_package_negative(spark):
    t = Tables(spark, SF_MID)
    tr = S.triplets(t["edge_docs"], t["node_docs"], "edge_id", "doc_id", seed=3, epoch=1)
    assert tr.count() == t["edge_docs"].count()
    pk = t["node_docs"].select("package", F.col("node").alias("node3"))
    assert tr.join(pk, ["package", "node3"], "left_anti").count() == 0
    # a new epoch redraws the negatives
    tr2 = S.triplets(t["edge_docs"], t["node_docs"], "edge_id", "doc_id", seed=3, epoch=2)
    same = tr.select("edge_id", "node3").intersect(tr2.select("edge_id", "node3")).count()
    assert same < 200
    assert tr.filter(F.col("source1").isNull() | F.col("source3").isNull()).count() == 0


def test_batches_sizes_and_padding(spark):
    t = Tables(spark, SF_MID)
    out = build_training_set(t["edge_docs"], t["node_docs"], batch_size=16, pad=True)
    sizes = out.groupBy("split", "batch_id").count().collect()
    by_split = {}
    for r in sizes:
        by_split.setdefault(r["split"], []).append((r["batch_id"], r["count"]))
    for split, rows in by_split.items():
        rows.sort()
        assert all(c == 16 for _, c in rows[:-1]) and 0 < rows[-1][1] <= 16
        assert [b for b, _ in rows] == list(range(len(rows)))
    bad = out.filter((F.size("ids1") != F.size("mask1")) | (F.size("ids2") > 256)).count()
    assert bad == 0
    assert out.count() == 1000


def test_vocabulary_ids(spark):
    df = spark.createDataFrame([(1, ["def", "f", "x", "def"]), (2, [])], "id long, toks array<string>")
    vocab = spark.createDataFrame([("def", 5), ("x", 7)], "token string, id int")
    got = {r["id"]: r["ids"] for r in S.vocabulary_ids(df, ["id"], "toks", vocab, unk_id=1).collect()}
    assert got == {1: [5, 1, 7, 5], 2: []}


def test_running_rank_keeps_null_keys(spark):
    from codeloom.operators.ranking import running_rank

    df = spark.createDataFrame([("a", 5), ("a", None), (None, 3), (None, 1 << 60), ("a", 2)], "g string, k long")
    for width in (None, 1, 1 << 16):
        got = {(r["g"], r["k"], r["_rank"]) for r in running_rank(df, ["g"], "k", width=width).collect()}
        assert got == {("a", None, 1), ("a", 2, 2), ("a", 5, 3), (None, 3, 1), (None, 1 << 60, 2)}
    assert running_rank(df.limit(0), [], "k").collect() == []


def test_edges_of_packages_without_nodes_stay(spark):
    from codeloom.operators import sampling as S

    edges = spark.createDataFrame([("p", 1, "a", "b"), ("q", 2, "c", "d")], "package string, edge_id long, node1 string, node2 string")
    nodes = spark.createDataFrame([("p", "a", "code", 1)], "package string, node string, source_code string, doc_id long")
    trip = S.triplets(edges, nodes, "edge_id", "doc_id")
    rows = {r["edge_id"]: (r["node3"], r["source1"], r["source3"]) for r in trip.collect()}
    assert rows == {1: ("a", "code", "code"), 2: (None, "nothing", "nothing")}
    assert [(r["package"], r["edges"]) for r in S.edges_without_negative(trip).collect()] == [("q", 1)]


def test_training_set_refuses_an_empty_side(spark):
    import pytest
    from codeloom.plans.training import build_training_set

    edges = spark.createDataFrame([("p", 1, "a", "b")], "package string, edge_id long, node1 string, node2 string")
    nodes = spark.createDataFrame([("p", "a", "code", 1)], "package string, node string, source_code string, doc_id long")
    with pytest.raises(ValueError, match="validation"):
        build_training_set(edges, nodes)


def test_word2vec_bounds(spark):
    from codeloom.operators.embed import train_embedder, vocabulary_floor
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(50) for _ in range(k)),)] * 3, "text string")
    staged = df.select(F.col("text").alias("_text"))
    assert vocabulary_floor(staged, 1000, 5) == 5 and vocabulary_floor(staged, 20, 5) == 95
    model = train_embedder(df, dim=4, max_vocab=20, rows_per_partition=1)
    assert 0 < model.stages[-1].getVectors().count() <= 20


def test_prompts_from_code_in_one_call(spark):
    from codeloom.plans.retrieval import build_prompts_from_code

    rows = [("d", k, f"f{k}(a)", " ".join(["alpha"] * k + ["beta"] * (9 - k))) for k in range(10)]
    df = spark.createDataFrame(rows, "dataset_name string, id long, signature string, raw_source_code string")
    got = {r["id"]: r["prompt"] for r in build_prompts_from_code(df, k=1).collect()}
    assert len(got) == 10 and rows[1][3] in got[0] and rows[8][3] in got[9]


def test_package_can_be_shipped(spark):
    import zipfile

    from codeloom.session import ship_package

    assert "codeloom/session.py" in zipfile.ZipFile(ship_package(spark)).namelist()


def test_skewed_orders_give_even_buckets(spark, monkeypatch):
    from codeloom.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 500)
    df = spark.range(40_000).select(F.pow(F.col("id") / 1000, F.lit(9)).cast("long").alias("x"), "id")
    sizes = [r["count"] for r in ranking.quantile_bucket(df, "x").groupBy("_bucket").count().collect()]
    assert 60 <= len(sizes) <= 81 and max(sizes) <= 1500  # the lowest 1,000 ids share the value 0
    got = ranking.running_rank(df, [], "x", tiebreak=["id"], out="r").where("r <> id + 1").count()
    assert got == 0
    even = ranking.even_bucket(df.select((F.col("id") * 25).alias("h")), "h", 1_000_000).groupBy("_bucket").count()
    assert {r["count"] for r in even.collect()} == {500}


def test_orders_are_planned_without_running_the_upstream(spark):
    """W3 writes its light table, and nothing else runs before the action; the others run nothing."""
    from codeloom.plans.registry import load_all
    from codeloom.sources.tables import BASE_TABLES, Tables
    from conftest import SF_SMALL

    t = Tables(spark, SF_SMALL)
    for name in BASE_TABLES:
        t[name]
    writes = []
    from codeloom.plans.catalog import sampling_q

    keep = sampling_q.cut_lineage
    try:
        sampling_q.cut_lineage = lambda df: writes.append(1) or df
        for name in ("W2_merged_index", "W3_assign_batches", "P18_pad_batch", "J5_triplets", "J4_edge_pairs"):
            spark.sparkContext.setJobGroup(f"plan-{name}", name)
            load_all()[name].build(t)
            assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")) == [], name
    finally:
        sampling_q.cut_lineage = keep
        spark.sparkContext.setJobGroup("tests", "tests")
    assert writes == [1]


def test_training_set_tokenises_each_node_once(spark):
    nodes = spark.createDataFrame([(f"p{k % 6}", f"n{k}", f"def f{k} ( a ) :" if k % 5 else None, k) for k in range(30)],
                                  "package string, node string, source_code string, doc_id long")
    edges = spark.createDataFrame([(f"p{k % 6}", k, f"n{k}", f"n{(k + 6) % 36}") for k in range(30)],
                                  "package string, edge_id long, node1 string, node2 string")
    out = build_training_set(edges, nodes, batch_size=4, val=0.5)
    # the three lookups read ids that were written once, not the texts
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 30 and all(len(r["ids1"]) == (6 if r["edge_id"] % 5 else 1) for r in rows)
