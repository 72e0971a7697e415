import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing
from test_bpe import known  # noqa: F401

SF = "/root/testdata/sf0.01"
FILE = P.path("byte_bpe_50k.tiktoken")


def brute(lengths, size):
    """Sequences that best-fit-decreasing opens, by looking at all of them each time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    return sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.data())
def test_packing_matches_brute_force(size, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, size), max_size=80)), np.int64)
    where, used = packing.best_fit_decreasing(lengths, size)
    load = np.bincount(where, lengths, used) if used else np.empty(0)
    assert sorted(size - load) == brute(lengths.tolist(), size)


def check(rows, docs, known, size, pad=50256):  # noqa: F811
    want = sorted((str(i), tuple(known.encode_ordinary(t))) for i, t in docs if t)
    pieces = {}
    for r in rows:
        ids, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(place) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert len(r.cu_seqlens) == len(r.segments) + 1 and (ids[r.n_tokens :] == pad).all() and not place[r.n_tokens :].any()
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert b - a == s.length > 0 and place[a:b].tolist() == list(range(b - a))
            pieces.setdefault((r.shard, s.doc_id), []).append((s.start, s.piece, tuple(ids[a:b].tolist())))
    got = []
    for (_, i), own in pieces.items():
        copies = sum(p[1] == 0 for p in own)
        if copies == 1:
            own.sort()
            ends = np.cumsum([len(p[2]) for p in own])
            assert [p[0] for p in own] == [0, *ends[:-1].tolist()] and [p[1] for p in own] == list(range(len(own)))
            got.append((str(i), sum((p[2] for p in own), ())))
        else:
            got += [(str(i), p[2]) for p in own]
    assert sorted(got) == want


def test_query_keeps_every_token(spark, known):  # noqa: F811
    from codeloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op4_token_packing"](spark, SF).collect()
    check(rows, docs, known, 2048)
    assert sum(r.n_tokens for r in rows) > 0.99 * 2048 * len(rows)


@pytest.mark.parametrize("size,shard_bytes", [(16, 8 << 20), (64, 3000), (1, 8 << 20)])
def test_odd_rows(spark, known, size, shard_bytes):  # noqa: F811
    rng = random.Random(15)
    docs = [(k, " ".join(rng.choice("the cat été 漢 42".split()) for _ in range(rng.randrange(0, 60)))) for k in range(50)]
    docs += [(None, "no id"), (100, None), (101, ""), (102, "a b"), (102, "a b"), (103, "long " * 5000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, ids int")
    rows = packing.pack_tokens(df, FILE, P.PATTERN, size=size, shard_bytes=shard_bytes).collect()
    if size > 1:
        check(rows, docs, known, size)
    else:
        assert len(rows) == sum(len(known.encode_ordinary(t or "")) for _, t in docs)
    assert packing.pack_tokens(df.limit(0), FILE, P.PATTERN).collect() == []
