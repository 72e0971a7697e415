"""Contexts of any length by an absolute count, against counted tuples."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import suffixtree
from test_suffixtree import same, tokens


def brute(rows, count, longest, weight, least):
    """As test_suffixtree.brute, for contexts of up to ``longest`` words; the suffixes of a context that stays do so, too."""
    grams = Counter()
    train = [tokens(t) for _, t, held in rows if not held]
    for w in train:
        for k in range(1, longest + 2):
            grams.update(zip(*(w[i:] for i in range(k))))
    n = sum(len(w) for w in train)
    v = sum(len(g) == 1 for g in grams)
    asked = {g for g, c in grams.items() if len(g) <= longest and None not in g and c >= count}

    def chain(w, k, use, o=0):
        p = (grams[w[k],] - o + 0.5) / (n - o + 0.5 * (v + 1))
        out = [p]
        for size in range(1, min(longest, k) + 1):
            s = tuple(w[k - size : k])
            if s not in use:
                break
            p = (grams[*s, w[k]] - o + weight * p) / (grams[s] - o + weight)
            out.append(p)
        return out

    gain = Counter()
    for w in train:
        for k in range(1, len(w)):
            p = chain(w, k, asked, 1)
            for size in range(1, len(p)):
                gain[tuple(w[k - size : k])] += math.log(p[size] / p[size - 1])
    stay = {s for s in asked if gain[s] >= least * grams[s]}
    stay |= {s[k:] for s in stay for k in range(1, len(s))}
    out = []
    for i, t, held in rows:
        w = tokens(t)
        p = [chain(w, k, stay) for k in range(len(w))]
        known = sum(grams[x,] > 0 for x in w)
        out.append((i, bool(held), len(w), known, n, sum(math.log10(x[0]) for x in p), sum(math.log10(x[-1]) for x in p)))
    return out, stay


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, held boolean")


def test_contexts_grow_with_the_corpus(spark):
    """Words that occur 8 times are contexts however large the rest is."""
    rows = [(k, "red fox jumps", False) for k in range(8)] + [(8, "red fox jumps", True)]
    rows += [(10 + k, " ".join(f"w{(k * 7 + i) % 5000}" for i in range(5000)), False) for k in range(120)]  # 8 of 600,000 are under 2e-5
    scored = {r.doc_id: r for r in suffixtree.score_texts(table(spark, rows), F.col("held"), weight=50.0).collect()}
    assert scored[8].score > scored[8].base_score + 1


def test_longer_contexts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):  # the word after three letters is told by the first of them
        words = []
        for _ in range(rng.randrange(1, 12)):
            a = rng.choice("pq")
            words += [a, rng.choice("xy"), rng.choice("xy"), a * 2]
        rows.append((k, " ".join(words), k % 5 == 1))
    scores = {}
    for longest in (1, 2, 3, 4):
        want, stay = brute(rows, 7, longest, 20.0, 0.01)
        assert longest < 3 or any(len(s) == 3 for s in stay)
        for size in (8 << 20, 1500):
            same(suffixtree.score_texts(table(spark, rows), F.col("held"), weight=20.0, longest=longest, chunk_bytes=size), want)
        scores[longest] = sum(r[6] for r in want if r[1])
    assert scores[3] > scores[2]


def test_a_context_keeps_its_suffixes(spark):
    """After b alone each word is as frequent as anywhere; after a b it is always c."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = []
        for _ in range(20):
            words += rng.choice((["a", "b", "c"], ["d", "b", rng.choice("abcdefgh")], [rng.choice("abcdefgh")]))
        rows.append((k, " ".join(words), k % 5 == 1))
    want, stay = brute(rows, 7, 2, 20.0, 0.6)
    assert ("a", "b") in {tuple(x.decode() if isinstance(x, bytes) else x for x in s) for s in stay}
    for size in (8 << 20, 1500):
        same(suffixtree.score_texts(table(spark, rows), F.col("held"), weight=20.0, least=0.6, chunk_bytes=size), want)
