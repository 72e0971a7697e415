import random
import zlib

import pytest

from codeloom.llm import variants as var

DOCS = "doc_id long, text string, word string, n int, id string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(vocab, factor=5):
    out = {}
    for w, n in vocab.items():
        around = [v for v in vocab if near(w, v)]
        top = min(around, key=lambda v: (-vocab[v], v), default=None)
        form = top if top is not None and vocab[top] >= factor * n else None
        out[w] = [form, w, n, len(around), vocab[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(x) for w, x in out.items()}


def group(spark, vocab, **more):
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    return {r.word: tuple(r)[1:] for r in var.group_variants(df, **more).collect()}


def sample(seed, letters, n, lengths):
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=r.choice(lengths))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        k = r.randrange(len(w))
        words.add(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]]))
    return {w: int(5 ** r.uniform(1, 6)) for w in sorted(words) if w}


@pytest.mark.parametrize(("most", "tasks"), [(16384, 16384), (3, 50), (1, 1)])
def test_matches_brute_force(spark, most, tasks):
    vocab = sample(most, "abé", 260, [1, 2, 3, 4, 6, 7]) | sample(7, "ab", 60, [8, 9]) | {"x" * 200: 9, "x" * 199: 900, "x" * 200 + "y": 7}
    got = group(spark, vocab, most=most, task_rows=tasks)
    assert got == brute(vocab)
    assert sum(x[0] is not None for x in got.values()) > 50


def test_hot_prefix_is_halved(spark):
    vocab = {"section" + w: n for w, n in sample(2, "abcd", 500, [5, 6, 7]).items()}
    assert group(spark, vocab, most=20, task_rows=200) == brute(vocab)


def test_acceptor_is_minimal():
    words = sorted({a + b + c for a in "ab" for b in ("", "c", "de") for c in ("x", "yz")})
    acceptor = var.Acceptor()
    start = acceptor.add(words)

    def accepted(state, read=""):
        yield from [read] if acceptor.final[state] else []
        for c, to in acceptor.arcs[state].items():
            yield from accepted(to, read + c)

    assert sorted(accepted(start)) == words
    languages = [frozenset(accepted(s)) for s in range(len(acceptor.arcs))]
    assert len(set(languages)) == len(languages)  # no two states accept the same
    assert acceptor.add([w for w in words if w[0] == "a"]) != start and len(acceptor.arcs) == len(languages) + 1


def misspelt(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def test_odd_rows_and_misspellings(spark):
    text = " ".join(f"Löwenzahn{k % 13:x}-LÖWENZAHN,straße{chr(97 + k % 26)}×÷é9abcdefg" for k in range(400))
    rows = [(1, text, "clash", 1, "x"), (None, text, "clash", None, "y"), (2, None, None, 3, None), (3, "", "w", 4, "z")]
    rows += [(k, "abcdefg KelvinK ſhort " * 3, "c", k, "d") for k in (5, 5, 6)]
    import re

    counts = {}
    for doc, body, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            w = misspelt(doc, run)
            counts[w] = counts.get(w, 0) + 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(rows, DOCS)
    got = var.spelling_variants(df, noise=199)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r)[1:] for r in got.collect()} == brute(vocab)
    assert len(vocab) > 20
    assert var.spelling_variants(spark.createDataFrame([], DOCS), noise=199).count() == 0
    none = spark.createDataFrame([("", 3), (None, 4), ("abc", None), ("abd", 2), ("abd", 3)], "word string, n long")
    assert [tuple(r) for r in var.group_variants(none).collect()] == [("abd", None, "abd", 5, 0, None)]
