import re

import pytest

from codeloom.llm import licenses as lic

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, labels string, _id int"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def places(words, phrase):
    p = phrase.split(" ")
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(text):
    words = WORD.findall(low(text))
    base = {p: places(words, p) for p in lic.BASE}
    at = sorted(i for x in base.values() for i in x)
    own = {lic.BASE[p] for p, x in base.items() if x}
    more = own | {label for p, label in lic.NOTICES.items() if places(words, p)}
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(own)), more


def test_query_matches_brute_force(spark):
    from codeloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op13_license_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        r, want = got[d.doc_id], brute(d.text)
        assert tuple(r)[1:6] == want[:5]
        if not any(tag in low(d.text) for tag in lic.TAGS):
            assert r.labels == ",".join(sorted(want[5]))
            assert r.score == max((lic.STRICT[x] for x in want[5]), default=0.0)
        seen += bool(want[1])
    assert seen


@pytest.mark.parametrize(
    ("text", "labels", "strict"),
    [
        ("mit", {"mit"}, 0.2),
        ("mit or gpl-3.0-only", {"mit", "gpl"}, 0.2),
        ("mit and gpl-3.0-only", {"mit", "gpl"}, 0.7),
        ("gpl-2.0-only with classpath-exception-2.0", {"gpl"}, 0.35),
        ("mit or agpl-3.0 and cc-by-nc-4.0", {"mit", "agpl", "cc-by-nc"}, 0.2),
        ("(mit or agpl-3.0) and cc-by-nc-4.0", {"mit", "agpl", "cc-by-nc"}, 0.9),
        ("((bsd-3-clause))", {"bsd"}, 0.2),
        ("apache-2.0 */ rest", {"apache"}, 0.25),
        ("mit mit gpl", {"mit"}, 0.2),  # an operand behind an operand ends the expression
        ("mit or", {"mit"}, 0.2),
        ("mit)", {"mit"}, 0.2),
        ("lgpl-2.1+", {"lgpl"}, 0.5),
        ("foo-1.0", {"unknown"}, 0.95),
    ],
)
def test_expressions(text, labels, strict):
    found = lic.read_expression(text)
    assert found.labels == labels and found.strict == pytest.approx(strict)


@pytest.mark.parametrize("text", ["", "or mit", "(mit", ")", "and", "*/", "\nmit"])
def test_no_expression(text):
    assert lic.read_expression(text) is None


def test_deep_nesting_does_not_recurse():
    n = 5000
    assert lic.read_expression("(" * n + "mit" + ")" * n).labels == {"mit"}
    assert lic.read_expression(" or ".join(["mit"] * n)).strict == 0.2


def test_odd_rows(spark):
    long = "x " * 30000 + "CC BY cc by"
    rows = [
        (1, None, "clash", 1), (None, "All rights\n\treserved.", "clash", 2), (2, "", None, 3), (2, "", None, 3),
        (3, long, "l", 4), (4, "acc by cc bye", "l", 5), (5, "# SPDX-License-Identifier: MIT OR Apache-2.0\nAll", "l", 6),
        (6, "CC\u00a0BY \u00c0cc by", "l", 7), (7, "License: see the file", "l", 8), (8, "License: GPL-2.0", "l", 9),
        (9, "cc by cc by general public license", "l", 10),
    ]
    got = lic.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].asDict() | {"score": 0.0} == got[0].asDict() and tuple(got[0])[1:] == (0, 0, None, None, "", "", 0.0)
    assert tuple(got[1]) == (None, 3, 1, 0, 0, "reserved", "reserved", 1.0)
    assert tuple(got[2]) == tuple(got[3]) == (2, 0, 0, None, None, "", "", 0.0)
    assert tuple(got[4])[1:6] == (30004, 2, 30000, 30002, "cc-by")
    assert tuple(got[5])[2:] == (0, None, None, "", "", 0.0)
    assert tuple(got[6])[5:] == ("", "apache,mit", 0.2)
    assert tuple(got[7])[1:3] == (3, 0)  # beyond ASCII everything is part of a word
    assert tuple(got[8])[5:] == ("", "", 0.0)
    assert tuple(got[9])[5:] == ("", "gpl", 0.7)
    assert tuple(got[10])[1:6] == (7, 3, 0, 4, "cc-by,gpl")
    assert lic.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
