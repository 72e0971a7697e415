import random

import numpy as np

from codeloom.llm import substrings
from codeloom.llm.fmindex import FMIndex
from codeloom.plans.oracle import compare, duck
from helpers import words

SF = "/root/testdata/sf0.01"


def brute(rows, n=13):
    least = {}
    for i, t in rows:
        i = 2**63 - 1 if i is None else i
        w = words(t)
        for a in range(len(w) - n + 1):
            s = tuple(w[a : a + n])
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - n + 1):
            if least[tuple(w[a : a + n])] < (2**63 - 1 if i is None else i):
                gone |= set(range(a, a + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    from codeloom.llm.queries import ORACLE, QUERIES

    name = "op6_substring_dedup"
    ok, msg = compare(QUERIES[name](spark, SF), ORACLE[name], duck(SF))
    assert ok, msg


def test_made_up_documents(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("a b c d é A".split())
    passage = [[f"p{k}w{j}" for j in range(60)] for k in range(3)]
    rows = [(1, None), (2, ""), (None, " ".join(passage[0])), (None, " ".join(passage[0])), (3, " \n\t"), (4, "x " * 40), (5, "x " * 40)]
    for d in range(10, 60):
        body = [word() for _ in range(rng.randrange(0, 60))]
        p = passage[d % 3]
        a = rng.randrange(0, 40)
        rows.append((d, rng.choice([" ", "\n", "  "]).join(body + p[a : a + rng.randrange(5, 30)] + [word() for _ in range(30)])))
    rows += [(70, rows[20][1]), (70, rows[20][1]), (-5, "q " + rows[21][1]), (80, " ".join(f"u{k % 700}" for k in range(30_000)))]
    df = spark.createDataFrame([(*r, "k", 1, 2, "t", 3) for r in rows], "doc_id long, text string, kept string, n_words int, shard int, _text string, _id int")
    want = brute(rows)
    assert got(substrings.remove_repeats(df)) == want
    assert got(substrings.remove_repeats(df, chunk_bytes=3000, shard_bytes=2000)) == want
    assert got(substrings.remove_repeats(df, chunk_bytes=3000, shard_bytes=2000, hot_chunks=2)) == want
    assert substrings.remove_repeats(df).columns == ["doc_id", "text", "shard", "_text", "_id", "kept", "n_words", "n_removed"]
    assert got(substrings.remove_repeats(df.limit(0))) == []


def test_chunks_without_windows(spark):
    rows = [(k, "a b c") for k in range(20)] + [(30, " ".join(map(str, range(13)))), (31, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.remove_repeats(df, chunk_bytes=4)) == brute(rows)
    assert got(substrings.remove_repeats(df.limit(3))) == brute(rows[:3])


def test_index_counts_patterns():
    rng = np.random.default_rng(7)
    text = np.append(rng.integers(1, 5, 3000), 0)
    index = FMIndex(text, 5, 8)
    for m in range(1, 9):
        ends = rng.integers(m, 3001, 50)
        lo, hi = index.begin(text[ends - 1])
        for k in range(1, m):
            lo, hi = index.extend(text[ends - 1 - k], lo, hi)
        for e, a, b in zip(ends, lo, hi):
            p = text[e - m : e]
            where = [x for x in range(3000 - m + 1) if np.array_equal(text[x : x + m], p)]
            assert sorted(index.suffixes[a:b].tolist()) == where


def test_segments_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    """With a hash that knows two values only, nothing but equal words counts as equal."""
    import numpy as np
    import pyarrow as pa

    from codeloom.llm import substrings

    texts = [" ".join(f"w{(k * 3 + i) % 7}" for i in range(13 + k % 3)) for k in range(30)] + ["a " * 20, "b " * 20, "a " * 20]
    table = pa.table({substrings.TEXT: pa.array([t.encode() for t in texts], pa.binary()), substrings.ID: pa.array(range(len(texts)), pa.int64())})
    monkeypatch.setattr(substrings, "run_hashes", lambda h, starts, lengths: (starts % 2).astype(np.uint64) << np.uint64(32))
    own = substrings.Segments(table, 13)
    assert len(np.unique(own.key)) <= 2
    own.settle()
    by_key, by_text = {}, {}
    for k in range(len(own.key)):
        by_key.setdefault(int(own.key[k]), set()).add(own.text(k))
        by_text.setdefault(own.text(k), set()).add(int(own.key[k]) >> 32)
    assert all(len(x) == 1 for x in by_key.values()) and len(by_key) > 10
