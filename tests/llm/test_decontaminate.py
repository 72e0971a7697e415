import random

import regex

from codeloom.llm import decontaminate
from codeloom.plans.oracle import compare, duck

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def brute(docs, items, n=5, t=0.8):
    out = []
    for i, text in items:
        w = plain_words(text)
        k = min(n, len(w))
        own = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
        for d, body in docs:
            v = plain_words(body)
            both = len(own & {tuple(v[a : a + k]) for a in range(len(v) - k + 1)})
            if own and both >= t * len(own):
                out.append((d, i, both, len(own)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    from codeloom.llm.queries import ORACLE, QUERIES

    name = "op3_benchmark_decontamination"
    ok, msg = compare(QUERIES[name](spark, SF), ORACLE[name], duck(SF))
    assert ok, msg


def test_short_items_in_long_documents_and_blocks(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 14, 20, 37, 59, 200, 700])]
    docs = [(d, " ".join(word() for _ in range(rng.randrange(1, 400)))) for d in range(30)]
    for k, (i, text) in enumerate(items):
        w = text.split()
        long = [word() for _ in range(8000)]
        at = rng.randrange(8000)
        docs.append((100 + k, " ".join(long[:at] + w + long[at:])))
        w2 = list(w)
        w2[len(w2) // 2] = "changed"
        docs.append((200 + k, "!! ".join(long[:at] + w2 + long[at:]).upper()))
    items += [(50, None), (51, ""), (52, " \n ")]
    docs += [(300, None), (301, ""), (302, items[7][1]), (302, items[7][1])]
    ddf = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, shared int, id string")
    idf = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) >= 20
    assert got(decontaminate.contaminated(ddf, idf)) == want
    assert got(decontaminate.contaminated(ddf, idf, block_bytes=500)) == want


def test_nulls_and_empty_tables(spark):
    ddf = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    idf = spark.createDataFrame([(None, "A B C D E"), (2, None)], "item_id long, text string")
    assert got(decontaminate.contaminated(ddf, idf)) == [(None, None, 1, 1)]
    assert got(decontaminate.contaminated(ddf.limit(0), idf)) == []
    assert got(decontaminate.contaminated(ddf, idf.limit(0))) == []
