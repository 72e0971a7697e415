"""A Python data source for call-graph JSON files of any size.

A file is one object that holds a long array; it is read piece by piece, and
the array's elements are decoded one after the other, so a task holds a piece
and an element, never the file.  ``spark.read.format("call_graph_json")`` with
the options ``path`` (as for :mod:`codeloom.sources.headed`), ``key`` (of the
array), ``tasks`` and ``piece`` (characters read at once) gives a row for each
element: ``file, id, function, callees``; other fields are left out.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from codeloom.sources.headed import Share, matching

NAME = "call_graph_json"
PIECE = 1 << 20
#: Characters of elements that one batch holds before it is sent on.
BATCH = 4 << 20
_BLANK = " \t\r\n"


class Pieces:
    """Text that is read as far as it is needed, and forgotten behind the place reached."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece = stream, piece
        self.text, self.at = "", 0
        self.decoder = json.JSONDecoder(strict=False)
        #: Most characters held at once.
        self.most = 0

    def more(self) -> bool:
        """Read on: as much again as is held, so that a long element is not decoded once for each piece."""
        part = self.stream.read(max(self.piece, len(self.text) - self.at))
        if not part:
            return False
        self.text, self.at = self.text[self.at:] + part, 0
        self.most = max(self.most, len(self.text))
        return True

    def peek(self) -> str:
        """The next character that is not blank, or nothing at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _BLANK:
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at:self.at + 1]

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            raise ValueError(f"expected {mark!r}, found {self.text[self.at:self.at + 20]!r}")
        self.at += 1

    def value(self):
        """The next JSON value."""
        self.peek()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise
                continue
            if end == len(self.text) and self.more():
                continue  # a number may go on in the next piece
            self.at = end
            return found


def elements(stream, key: str, piece: int = PIECE, pieces: Pieces | None = None) -> Iterator:
    """Elements of the array ``key`` of the object that ``stream`` holds."""
    p = pieces or Pieces(stream, piece)
    p.take("{")
    while p.peek() != "}":
        name = p.value()
        p.take(":")
        if name != key or p.peek() != "[":
            p.value()
        else:
            p.take("[")
            while p.peek() != "]":
                yield p.value()
                if p.peek() != "]":
                    p.take(",")
            p.take("]")
        if p.peek() != "}":
            p.take(",")


class CallGraphJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, id string, function string, callees array<string>"

    def reader(self, schema) -> CallGraphReader:
        return CallGraphReader(dict(self.options))


class CallGraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key = options["path"], options["key"]
        self.tasks, self.piece = int(options.get("tasks", 8)), int(options.get("piece", PIECE))

    def partitions(self) -> list[Share]:
        return [Share(k) for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for system, path, name in matching(self.path, partition.number, self.tasks):
            with io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8-sig") as text:
                try:
                    yield from self._rows(text, name)
                except (json.JSONDecodeError, ValueError) as e:
                    raise ValueError(f"{name}: {e}") from None

    def _rows(self, text, name: str) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for e in elements(text, self.key, self.piece):
            if not isinstance(e, dict):
                continue
            callees = e.get("callees")
            rows.append((name, _text(e.get("id")), _text(e.get("function")), callees and [_text(c) for c in callees]))
            size += 100 + sum(len(c or "") for c in rows[-1][3] or ())
            if size > BATCH:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["file", "id", "function", "callees"])


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)
