"""Call-graph JSON in bounded pieces."""

import io
import json

import pytest

from codeloom.sources import readers as R
from codeloom.sources.streamed import Pieces, elements

KEY = "call-graph-v1.0"


def _graph(n, long=0):
    return [{"id": f"n{k}", "function": f'm.py:<module>:f"{k}"\n', "callees": [f"c{j}" for j in range(k % 4)], "source": "x{[\\" * long} for k in range(n)]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_elements_whatever_the_pieces(piece):
    graph = _graph(50, long=3)
    text = json.dumps({"version": [1, {"a": [2]}], "n": 12345, KEY: graph, "after": None}, indent=1)
    assert list(elements(io.StringIO(text), KEY, piece)) == graph
    assert list(elements(io.StringIO('{"' + KEY + '": [1, 22, true, null]}'), KEY, piece)) == [1, 22, True, None]
    assert list(elements(io.StringIO('{"other": []}'), KEY, piece)) == []
    assert list(elements(io.StringIO('{"' + KEY + '": null}'), KEY, piece)) == []


@pytest.mark.parametrize("text", ["", "[]", "{", '{"' + KEY + '": [', '{"' + KEY + '": [{"id": 1}', '{"' + KEY + '": [{"id": 1} {"id": 2}]}'])
def test_what_is_no_such_object_raises(text):
    with pytest.raises(ValueError):
        list(elements(io.StringIO(text), KEY, 5))


def test_a_large_file_is_held_in_pieces():
    text = json.dumps({KEY: _graph(20_000, long=10)})
    pieces = Pieces(io.StringIO(text), 4096)
    assert sum(1 for _ in elements(None, KEY, pieces=pieces)) == 20_000
    assert len(text) > 2_000_000 and pieces.most < 10_000


def test_reader_with_a_small_limit(spark, tmp_dir):
    graph = _graph(300, long=40)
    for name, part in (("a", graph), ("b", [{"id": 1, "function": "f"}])):
        with open(f"{tmp_dir}/{name}-graph-order.json", "w") as f:
            json.dump({KEY: part}, f)
    entries, calls = R.read_call_graph(spark, f"{tmp_dir}/*-graph-order.json", piece=100)
    assert {(r["package"], r["id"], r["function"]) for r in entries.collect()} == {("a", e["id"], e["function"]) for e in graph} | {("b", "1", "f")}
    want = {("a", e["function"], k, c) for e in graph for k, c in enumerate(e["callees"])}
    assert {(r["package"], r["caller"], r["pos"], r["callee"]) for r in calls.collect()} == want
    with open(f"{tmp_dir}/c-graph-order.json", "w") as f:
        f.write('{"call-graph-v1.0": [{"id": "x"')
    with pytest.raises(Exception, match="c-graph-order.json"):
        R.read_call_graph(spark, f"{tmp_dir}/*-graph-order.json")[0].collect()
