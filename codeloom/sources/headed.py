"""A Python data source for CSV files that are read by their own headers.

``spark.read.format("headed_csv")`` maps the columns of every file to those
asked for, whatever their order and whatever else the file holds, in one pass:
a task lists its share of the folders, opens its files one after the other and
streams their rows as Arrow batches.  The driver neither lists files nor unions
layouts.  Options:

``path``      folders and files; ``*``, ``?`` and ``[...]`` match within a name
``columns``   JSON object: output column -> names in the header, the first found counts
``required``  JSON list of output columns that every file must have
``each``      JSON list of header names: those a file has become the map ``each``, one at least
``tasks``     number of tasks; a folder (or file) at the first wildcard is dealt by its name's hash
``only``      ``headers``: no rows, but the number of files and what is wrong with a header

An empty cell is null unless it is quoted; cells may hold line breaks and
doubled quotes; short rows end in nulls.  Names that begin with ``_`` or ``.``
are left out, compressed files are read as their suffix says.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "headed_csv"
#: Characters of text that one batch holds before it is sent on.
BATCH = 4 << 20
_WILD = re.compile(r"[*?\[]")


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what to put before its paths."""
    found = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(/.*)$", path)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), "/" + (found[2] if found else path).lstrip("/"), ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
    return sorted((x for x in found if x.base_name[:1] not in ("_", ".")), key=lambda x: x.base_name)


def matching(path: str, share: int = 0, tasks: int = 1) -> Iterator[tuple[fs.FileSystem, str, str]]:
    """Files of one task: (file system, path there, name to report)."""
    system, inner, before = _opened(path)
    names = [x for x in inner.split("/") if x]
    mine = lambda name: zlib.crc32(name.encode()) % tasks == share

    def below(folder: str, rest: list[str], dealt: bool):
        if not rest:
            yield folder, dealt
            return
        literal = posixpath.join(folder, rest[0])
        if not _WILD.search(rest[0]) or system.get_file_info(literal).type != fs.FileType.NotFound:
            yield from below(literal, rest[1:], dealt)
            return
        for x in _listed(system, folder):
            if fnmatch.fnmatchcase(x.base_name, rest[0]) and (dealt or mine(x.base_name)):
                yield from below(x.path, rest[1:], True)

    for found, dealt in below("/" if inner.startswith("/") else "", names, False):
        if system.get_file_info(found).type == fs.FileType.File and (dealt or mine(posixpath.basename(found))):
            yield system, found, before + found


class Share(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class HeadedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if self.options.get("only") == "headers":
            return "files long, fault string"
        each = ", each map<string, string>" if "each" in self.options else ""
        return ", ".join(["file string", *(f"`{c}` string" for c in json.loads(self.options["columns"]))]) + each

    def reader(self, schema) -> HeadedReader:
        return HeadedReader(dict(self.options))


class HeadedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.tasks = int(options.get("tasks", 8))
        self.columns = {c: [x] if isinstance(x, str) else x for c, x in json.loads(options["columns"]).items()}
        self.required = json.loads(options.get("required", "[]"))
        self.each = json.loads(options["each"]) if "each" in options else None
        self.headers_only = options.get("only") == "headers"

    def partitions(self) -> list[Share]:
        return [Share(k) for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if self.headers_only:
            files, fault = 0, None
            for system, path, name in matching(self.path, partition.number, self.tasks):
                with self._text(system, path) as text:
                    header = self._header(csv.reader(text))
                files += bool(header)
                fault = fault or (header and self._fault(header, name)) or None
            yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64()), "fault": pa.array([fault], pa.string())})
            return
        csv.field_size_limit((1 << 31) - 1)
        for system, path, name in matching(self.path, partition.number, self.tasks):
            yield from self._rows(system, path, name)

    @staticmethod
    def _text(system: fs.FileSystem, path: str) -> io.TextIOWrapper:
        return io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8-sig", errors="replace", newline="")

    @staticmethod
    def _header(rows) -> list[str]:
        return [(x or "").strip() for x in next(rows, [])]

    def _fault(self, header: list[str], name: str) -> str | None:
        named = [x for x in header if x]
        if len(set(named)) < len(named):
            return f"a column occurs twice in the header {header} of {name}"
        missing = [self.columns[c] for c in self.required if not set(self.columns[c]) & set(header)]
        if self.each is not None and (missing or not set(self.each) & set(header)):
            return f"no reference or variant column in {header} of {name}"
        if missing:
            return f"missing column(s) {[' or '.join(m) for m in missing]} in {name}"
        return None

    def _rows(self, system: fs.FileSystem, path: str, name: str) -> Iterator[pa.RecordBatch]:
        with self._text(system, path) as text:
            rows = csv.reader(text, quoting=csv.QUOTE_NOTNULL)  # an empty cell is None unless it is quoted
            header = self._header(rows)
            if not header:
                return
            fault = self._fault(header, name)
            if fault:
                raise ValueError(fault)
            at = [next((header.index(x) for x in names if x in header), None) for names in self.columns.values()]
            each = [(x, header.index(x)) for x in self.each or () if x in header]
            held, size = [], 0
            for row in rows:
                if not row:
                    continue
                row += [None] * (len(header) - len(row))
                cells = [None if k is None else row[k] for k in at]
                held.append(cells + [[(x, row[k]) for x, k in each]])
                size += sum(len(c) for c in row if c)
                if size > BATCH:
                    yield self._batch(name, held)
                    held, size = [], 0
            if held:
                yield self._batch(name, held)

    def _batch(self, name: str, rows: list) -> pa.RecordBatch:
        *cols, each = zip(*rows)
        out = {"file": pa.array([name] * len(rows), pa.string())}
        out |= {c: pa.array(list(x), pa.string()) for c, x in zip(self.columns, cols)}
        if self.each is not None:
            out["each"] = pa.array(list(each), pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_pydict(out)
