import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from codeloom.llm import bpe

SF = "/root/testdata/sf0.01"
FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder.from_file(open(FILE, "rb").read(), P.PATTERN)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def digests(known, text):
    ids = known.encode_ordinary(text or "")
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def test_query_matches_the_library(spark, known):
    from codeloom.llm.queries import QUERIES

    want = {r.doc_id: digests(known, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_byte_bpe"](spark, SF).collect()}
    assert got == want


ODD = ["", " ", "\n\n \t x", "don't they'LL we've", "a" * 700, "ab" * 900, "été ñandú 漢字かな 🙂🙂", "<|endoftext|>", "1234 5678x",
       "the" * 2000, "!?" * 3000, "  x", "\r\n\r\n", "=" * 5000, "x" * 60_000]


def test_odd_texts(known, ours):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aeinrst 'd.\n") for _ in range(rng.randrange(1, 3000))) for _ in range(50)]
    texts += ["".join(rng.choice("the") for _ in range(rng.randrange(30, 1500))) for _ in range(30)]
    for t, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == known.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_heap_and_matrix_agree(ours):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"thein. ") for _ in range(rng.randrange(2, 900))) for _ in range(60)]
    for a, b in zip(ours.merge_matrix(pieces), map(ours.merge_heap, pieces)):
        assert a.tolist() == b.tolist()


def test_forgetting_pieces_changes_nothing(known, ours):
    ours.cache_size, kept = 1, ours.cache_size
    for t in ("one two three", "two three four five", "one five"):
        assert ours.encode([t])[0].tolist() == known.encode_ordinary(t)
    ours.cache_size = kept


def test_nulls_clashing_columns_and_empty_table(spark, known):
    df = spark.createDataFrame([(1, None, 5, "a"), (None, "x y", None, None), (1, "x y", 5, "a")], "doc_id long, text string, ids int, decoded string")
    rows = bpe.decode(bpe.encode(df, FILE, P.PATTERN), FILE, P.PATTERN).collect()
    assert [r.doc_id for r in rows] == [1, None, 1]
    assert [bytes(r.decoded) for r in rows] == [b"", b"x y", b"x y"]
    assert {(r.doc_id, r.n_tokens) for r in bpe.round_trip(df, FILE, P.PATTERN).collect()} == {(1, 0), (None, 2), (1, 2)}
    assert bpe.round_trip(df.limit(0), FILE, P.PATTERN).collect() == []
