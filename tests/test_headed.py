"""CSV files by their own headers: shares of folders, one pass, cells as written."""

import json
import os

import pytest

from codeloom.sources import headed
from codeloom.sources import readers as R


def _put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _rows(path, tasks=1, **options):
    options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    reader = headed.HeadedReader(options | {"path": path, "tasks": str(tasks)})
    return [b.to_pylist() for share in reader.partitions() for b in reader.read(share)]


def test_shares_hold_every_file_once(tmp_dir):
    for k in range(40):
        _put(f"{tmp_dir}/p [{k}]/nodes.csv", f"x,a\n,{k}\n")
    _put(f"{tmp_dir}/_hidden/nodes.csv", "a\n99\n")
    _put(f"{tmp_dir}/p [1]/edges.csv", "a\n98\n")
    found = [[f for _, f, _ in headed.matching(f"{tmp_dir}/*/nodes.csv", k, 7)] for k in range(7)]
    assert sum(map(len, found)) == 40 and len({f for x in found for f in x}) == 40 and min(map(len, found)) > 0
    got = sorted(int(r["a"]) for b in _rows(f"{tmp_dir}/*/nodes.csv", 7, columns={"a": "a"}) for r in b)
    assert got == list(range(40))
    assert len(list(headed.matching(f"file://{tmp_dir}/p [3]/nodes.csv", 0, 1))) == 1  # a name with wildcards in it


def test_a_file_is_opened_once(tmp_dir, monkeypatch):
    for k in range(5):
        _put(f"{tmp_dir}/p{k}/n.csv", "a,b\n1,2\n" if k % 2 else "b,c,a\n2,3,1\n")
    opened = []
    keep = headed.HeadedReader._text
    monkeypatch.setattr(headed.HeadedReader, "_text", staticmethod(lambda system, path: opened.append(path) or keep(system, path)))
    rows = [(r["a"], r["b"]) for b in _rows(f"{tmp_dir}/*/n.csv", 3, columns={"a": "a", "b": "b"}) for r in b]
    assert rows == [("1", "2")] * 5 and len(opened) == len(set(opened)) == 5


def test_cells(tmp_dir, monkeypatch):
    monkeypatch.setattr(headed, "BATCH", 10)
    _put(f"{tmp_dir}/a.csv", '﻿"key\nname",b,\r\n"x, ""y""\r\nz",,1\r\n\r\n"",  k \r\nshort\r\n1,2,3,4\r\n')
    out = _rows(f"{tmp_dir}/a.csv", columns={"k": ["other", "key\nname"], "b": "b", "none": "absent"})
    assert len(out) > 1  # long files are sent on in batches
    assert [(r["k"], r["b"], r["none"]) for b in out for r in b] == [
        ('x, "y"\r\nz', None, None), ("", "  k ", None), ("short", None, None), ("1", "2", None)]


def test_each_becomes_a_map(tmp_dir):
    _put(f"{tmp_dir}/a.csv", "r,v2,v1\nx,,1\n")
    (row,), = _rows(f"{tmp_dir}/a.csv", columns={"r": "r"}, required=["r"], each=["v1", "v2", "v3"])
    assert dict(row["each"]) == {"v1": "1", "v2": None}
    with pytest.raises(ValueError, match="no reference or variant"):
        _rows(f"{tmp_dir}/a.csv", columns={"r": "r"}, required=["r"], each=["v3"])


def test_faults_are_told_now_or_when_read(spark, tmp_dir):
    _put(f"{tmp_dir}/d/function_base.csv", "a,b,a\n1,2,3\n")
    with pytest.raises(ValueError, match="occurs twice"):
        R.read_function_base(spark, tmp_dir)
    later = R.read_function_base(spark, tmp_dir, check=False)
    with pytest.raises(Exception, match="occurs twice"):
        later.collect()
    with pytest.raises(ValueError, match="no file"):
        R.read_function_base(spark, f"{tmp_dir}/nothing")
