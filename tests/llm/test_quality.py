import random
import zlib

import numpy as np
import pyarrow as pa

from codeloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from codeloom.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    for y in (0, 1):
        right = [rows[r.doc_id].predicted == y for r in labels if r.quality == y]
        assert sum(right) > 0.97 * len(right) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def text(rng, bad):
    w = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(5, 60))]
    return " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."


def test_votes_match_brute_force():
    rng = random.Random(8)
    train = [text(rng, k % 2) for k in range(60)]
    x = np.concatenate([c for _, c in quality.counts(pa.array([t.encode() for t in train], pa.binary()))])
    y = np.array([1 - k % 2 for k in range(60)])
    m = quality.Neighbours(x.copy(), y, 16, 5)
    asked = [text(rng, k % 2) for k in range(40)] + train[:3]
    q = np.concatenate([c for _, c in quality.counts(pa.array([t.encode() for t in asked], pa.binary()))])
    v = (q * m.idf) @ m.basis
    for s, row in zip(m.scores(pa.array([t.encode() for t in asked], pa.binary())), v):
        sim = sorted(((float(np.dot(row, u) / np.linalg.norm(row)), int(z)) for u, z in zip(m.vectors, y)), reverse=True)[:5]
        assert abs(s - sum(c * c * z for c, z in sim if c > 0) / sum(c * c for c, _ in sim if c > 0)) < 1e-4


def test_counts_do_not_depend_on_the_batch():
    rng = random.Random(9)
    texts = [text(rng, k % 3 == 0).encode() for k in range(700)] + [b"", b" ", b"one", b"x" * 100_000]
    whole = np.concatenate([c for _, c in quality.counts(pa.array(texts, pa.binary()))])
    for k in (0, 1, 511, 512, 699, 700, 701, 702, 703):
        assert np.array_equal(next(quality.counts(pa.array([texts[k]], pa.binary())))[1][0], whole[k])


def test_odd_rows(spark):
    rng = random.Random(10)
    rows = [(k, text(rng, k % 2), "keep") for k in range(80)] + [(None, "abc def", None), (200, None, ""), (201, "", "z"), (201, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)] + [(None, 1), (5, None), (6, 7), (999, 0)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == 84 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).collect() == []
