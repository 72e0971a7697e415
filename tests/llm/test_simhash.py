import random

import pandas as pd
import xxhash

from codeloom.llm import simhash
from codeloom.llm.components import components
from helpers import low_words, roots

SF = "/root/testdata/sf0.01"


def brute_print(text, n=4):
    w = low_words(text)
    if not w:
        return 0
    runs = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    prints = {i: brute_print(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(ids, links)
    return {i: (format(prints[i], "016x"), root[i]) for i in ids}


def got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark):
    from codeloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op1_simhash_near_dedup"](spark, SF)) == brute([(r.doc_id, r.text) for r in docs])


def test_hand_made_texts_and_clashing_columns(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE\vTwo"), (6, "été À la mer"), (7, "x" * 200_000)]
    for k in range(40):
        w = list(base)
        w[rng.randrange(400)] = f"z{k}"
        rows.append((10 + k, " ".join(w)))
    pdf = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "fp": 0, "u": 1, "rep": "x", "root": 2})
    out = simhash.near_duplicates(spark.createDataFrame(pdf, "doc_id long, text string, fp int, u int, rep string, root int"))
    assert got(out) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "lonely words here")], "doc_id long, text string")
    out = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert len(out) == 4 and out.count((7, 7)) == 2 and (None, 7) in out and (None, None) in out
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_split_buckets_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(300)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = roots(signed, [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    for limit in (7, 512):
        have = {r.node: r.root for r in components(simhash.close_pairs(df, limit=limit)).collect()}
        assert {p: have.get(p, p) for p in signed} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 501), (None, 3)], "u long, v long")
    have = {r.node: r.root for r in components(links).collect()}
    assert have == {k: 0 for k in range(201)} | {500: 500, 501: 500}
