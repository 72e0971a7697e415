"""Plain-Python restatements shared by the tests of the training-data operators."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def low_words(text):
    return WORD.findall((text or "").encode().lower())


def roots(nodes, links):
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
