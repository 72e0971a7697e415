"""File sources: package lists, archives, source trees, analyzer output,
graph CSVs, function bases, result CSVs and metric JSONs.

Every reader returns a long DataFrame keyed by ``package`` / ``dataset_name``
(taken from the file path), so a whole corpus is one scan.  Schemas are
explicit; nothing is inferred from data except JSON metric keys.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import tarfile
import zlib
from itertools import islice
from typing import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import NA_WORDS
from codeloom.sources.headed import NAME as HEADED
from codeloom.sources.headed import HeadedCsv, _opened
from codeloom.sources.streamed import NAME as CALL_GRAPH
from codeloom.sources.streamed import PIECE, CallGraphJson

CALL_GRAPH_KEY = "call-graph-v1.0"
#: Text of one archive sent on at once.
MEMBER_BYTES = 4 << 20
#: Paths of source files sent on at once.
LISTED = 10_000
NODE_SCHEMA = "node string, source_code string, description string, signature string"
EDGE_SCHEMA = "node1 string, node2 string, type int"


def _path_col() -> Column:
    """The file's path as it is named: Spark reports it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def parent_folder(path: Column, up: int = 1) -> Column:
    """Name of the folder ``up`` levels above the file; a Hive-style
    ``key=value`` folder (as Spark's partitioned writers make) gives ``value``."""
    name = F.element_at(F.split(path, "/"), -1 - up)
    value = F.regexp_replace(name, "^[^=]*=", "")
    value = F.when(value != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))
    return F.when(F.contains(name, F.lit("=")), value).otherwise(name)


def file_stem(path: Column, suffix: str) -> Column:
    """File name without ``suffix``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, re.escape(suffix) + "$", "")


def _headed(spark: SparkSession, path: str, check: bool, **options) -> DataFrame:
    """CSV files of ``path`` by their own headers (:mod:`codeloom.sources.headed`), each read once.

    With ``check`` the headers alone are looked at first, in tasks: a bad one, or
    none at all, raises here and not when the rows are read.
    """
    spark.dataSource.register(HeadedCsv)
    options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    options |= {"path": path, "tasks": str(2 * spark.sparkContext.defaultParallelism)}
    if check:
        told = spark.read.format(HEADED).options(**options, only="headers").load()
        files, fault = told.agg(F.sum("files"), F.min("fault")).first()
        if fault or not files:
            raise ValueError(fault or f"no file with a header matches {path}")
    return spark.read.format(HEADED).options(**options).load().withColumnRenamed("file", "_file")


# S1 -------------------------------------------------------------------------
def package_list(lines: DataFrame, col: str = "value", distinct: bool = False) -> DataFrame:
    """Trimmed non-blank lines as ``name``; ``distinct`` drops repeats."""
    out = lines.select(F.trim(F.col(col)).alias("name")).filter(F.col("name") != "")
    return out.dropDuplicates(["name"]) if distinct else out


def read_package_list(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    return package_list(spark.read.text(path), distinct=distinct)


# S2 -------------------------------------------------------------------------
def _members(content: bytes, suffix: str | None) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
        for m in tar:
            if m.isfile() and (not suffix or m.name.endswith(suffix)):
                yield m.name, tar.extractfile(m).read()


def _untar(batches: Iterator[pa.RecordBatch], suffix: str | None) -> Iterator[pa.RecordBatch]:
    names = ["path", "member", "content", "error"]

    def table(path, rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(list(c), pa.string()) for c in cols)], names=names)

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            content = content.as_py()
            try:  # read to the end first: of a bad archive no member stays
                for _ in _members(content, suffix):
                    pass
            except Exception as e:  # noqa: BLE001 - a bad archive is reported and skipped
                yield table(path, [(None, None, f"{type(e).__name__}: {e}")])
                continue
            rows, size = [], 0
            for name, data in _members(content, suffix):
                try:
                    rows.append((name, data.decode("utf-8"), None))
                except UnicodeDecodeError as e:
                    rows.append((name, data.decode("utf-8", errors="replace"), f"decoded with replacements: {e}"))
                size += len(data)
                if size > MEMBER_BYTES:
                    yield table(path, rows)
                    rows, size = [], 0
            if rows:
                yield table(path, rows)


def read_archives(spark: SparkSession, glob: str, suffix: str | None = ".py", name_from: str = "file") -> DataFrame:
    """Members of ``.tar.gz`` archives as rows ``archive, path, content, error``
    (read in memory on executors; nothing is unpacked to disk or deleted).

    ``archive`` is the file's name without its suffix, or the name of its folder
    with ``name_from='folder'``.  An archive that cannot be read to its end gives
    one row with its error; a member that is not UTF-8 says so in ``error``.
    """
    raw = spark.read.format("binaryFile").load(glob).select(_path_col().alias("path"), "content")
    rows = raw.mapInArrow(lambda it: _untar(it, suffix), schema="path string, member string, content string, error string")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.tar)?\.[^.]*$", "")
    archive = parent_folder(F.col("path")) if name_from == "folder" else stem
    return rows.select(archive.alias("archive"), F.col("member").alias("path"), "content", "error")


# S3 -------------------------------------------------------------------------
def normalize_newlines(c) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n`` (Python text-mode reading)."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")


def _name_pattern(pattern: str) -> re.Pattern:
    """A glob over file names as Hadoop takes it: ``* ? [..] [^..] {a,b}`` and ``\\`` before a character."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        x = pattern[k]
        end = pattern.find("]", k + 2) if x == "[" else -1
        if x == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif end > 0:
            inner = pattern[k + 1:end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("\\", "\\\\") + "]")
            k = end
        elif x in "{}" or (x == "," and depth):
            depth += {"{": 1, "}": -1, ",": 0}[x]
            out.append({"{": "(?:", "}": ")", ",": "|"}[x])
        else:
            out.append({"*": ".*", "?": "."}.get(x) or re.escape(x))
        k += 1
    return re.compile("".join(out), re.DOTALL)


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder and whether they are folders, one by one where the file system can."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                yield x.name, x.is_dir()
    else:
        for x in system.get_file_info(fs.FileSelector(folder.rstrip("/") or "/")):
            yield x.base_name, x.type == fs.FileType.Directory


def _left_out(name: str, folder: bool) -> bool:
    """Names that Spark's file sources pass over."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _paths_below(root: str, pattern: str, share: int, tasks: int) -> Iterator[str]:
    """Matching files of one task, relative to ``root``: its share of what lies in ``root`` by the names' hash, and all that is below."""
    system, base, _ = _opened(root)
    wanted, todo = _name_pattern(pattern), [""]
    while todo:
        folder = todo.pop()
        for name, is_folder in _entries(system, posixpath.join(base, folder)):
            if (not folder and zlib.crc32(name.encode()) % tasks != share) or _left_out(name, is_folder):
                continue
            if is_folder:
                todo.append(posixpath.join(folder, name))
            elif wanted.fullmatch(name):
                yield posixpath.join(folder, name)


def _whole_files(root: str):
    """``path, content`` of the files named by their paths; an empty file gives no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = _opened(root)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["path", "content"])
        rows, size = [], 0
        for path in (x for b in batches for x in b.column(0).to_pylist()):
            with system.open_input_stream(posixpath.join(base, path)) as f:
                content = f.read()
            if content:
                rows.append((path, content))
                size += len(content)
            if size > MEMBER_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read_source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """``package, path, content`` for every matching file below ``root``;
    ``package`` is the first folder under ``root``, ``path`` is relative to it.

    Tasks list the folders, each but ``root`` once, and the paths are dealt to
    those that read the files: the driver holds no list of them.
    """
    system, base, _ = _opened(root)
    kind = system.get_file_info(base).type
    if kind == fs.FileType.File or (kind == fs.FileType.NotFound and re.search(r"[*?\[{]", root)):
        raise ValueError(f"not below {root}: it is no folder")
    if kind == fs.FileType.NotFound:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    tasks = 2 * spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in (x for b in batches for x in b.column(0).to_pylist()):
            paths = _paths_below(root, pattern, share, tasks)
            while some := list(islice(paths, LISTED)):
                yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    # an explicit partition count: what is read is much larger than the paths that are dealt
    readers = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = spark.range(0, tasks, 1, tasks).mapInArrow(listed, "path string").repartition(readers, "path")
    return paths.mapInArrow(_whole_files(root), "path string, content binary").select(
        F.split_part("path", F.lit("/"), F.lit(1)).alias("package"),
        "path",
        normalize_newlines(F.col("content").cast("string")).alias("content"),
    )


# S4 -------------------------------------------------------------------------
def read_call_graph(spark: SparkSession, glob: str, suffix: str = "-graph-order.json",
                    name_from: str = "file", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``(entries, calls)``: ``package, id, function`` and
    ``package, caller, pos, callee``; the package is the file name without
    ``suffix`` (or the folder's, with ``name_from='folder'``).  Fields other than ``id/function/callees`` are pruned.

    A file is read in pieces of ``piece`` characters and its entries one by one
    (:mod:`codeloom.sources.streamed`), so it may be of any size; one that is no
    such object ends the job with its name."""
    spark.dataSource.register(CallGraphJson)
    tasks = str(2 * spark.sparkContext.defaultParallelism)
    raw = spark.read.format(CALL_GRAPH).options(path=glob, key=CALL_GRAPH_KEY, tasks=tasks, piece=str(piece)).load()
    path = F.col("file")
    pkg = (parent_folder(path) if name_from == "folder" else file_stem(path, suffix)).alias("package")
    e = raw.select(pkg, "id", "function", "callees")
    calls = e.select("package", F.col("function").alias("caller"),
                     F.posexplode(F.coalesce("callees", F.array().cast("array<string>"))).alias("pos", "callee"))
    return e.select("package", "id", "function"), calls


# S5 -------------------------------------------------------------------------
def read_analyzer_log(spark: SparkSession, glob: str, suffix: str = ".log", name_from: str = "file") -> DataFrame:
    """``package, line_no, line``; ``line_no`` grows along a file, with gaps.

    Lines are read in splits: a line's number is twice the offset of its split
    plus its place among the lines of its task, which has fewer lines than the
    split has bytes.  ``package`` is the file's name without ``suffix``, or its
    folder with ``name_from='folder'``.
    """
    path = _path_col()
    pkg = parent_folder(path) if name_from == "folder" else file_stem(path, suffix)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(glob).select(
        pkg.alias("package"), (F.col("_metadata.file_block_start") * 2 + place).alias("line_no"), F.col("value").alias("line"))


# S6 -------------------------------------------------------------------------
def _null_na(c: str, na_words=NA_WORDS) -> Column:
    return F.when(F.col(c).isin(*na_words), F.lit(None).cast("string")).otherwise(F.col(c))


def read_graph(spark: SparkSession, root: str, layout: str = "folders", check: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of every package under ``root``, each file read by its header.

    ``layout='folders'``: ``root/<package>/nodes.csv`` and ``edges.csv`` (a
    package missing either file is skipped); ``'partitioned'`` and ``'parquet'``:
    the layouts of :func:`codeloom.sources.writers.write_graph`.  Absent columns
    (an edge's ``type``, a node's description or signature) read as null;
    pandas' missing-value words in ``source_code`` read as null.  ``check``:
    look at the headers now instead of failing when the rows are read.
    """
    root = root.rstrip("/")
    if layout == "parquet":
        nodes, edges = (spark.read.schema(f"{schema}, package string").parquet(f"{root}/{name}")
                        for schema, name in ((NODE_SCHEMA, "nodes"), (EDGE_SCHEMA, "edges")))
    else:
        where = {"folders": ("*/nodes.csv", "*/edges.csv"), "partitioned": ("nodes/*/*.csv", "edges/*/*.csv")}
        if layout not in where:
            raise ValueError(f"unknown layout {layout!r}")
        kept = lambda schema: {c.split()[0]: c.split()[0] for c in schema.split(", ")}
        nodes = _headed(spark, f"{root}/{where[layout][0]}", check, columns=kept(NODE_SCHEMA), required=["node", "source_code"])
        edges = _headed(spark, f"{root}/{where[layout][1]}", check, columns=kept(EDGE_SCHEMA), required=["node1", "node2"])
        nodes = nodes.withColumn("package", parent_folder(F.col("_file"))).withColumn("source_code", _null_na("source_code"))
        edges = edges.withColumn("package", parent_folder(F.col("_file"))).withColumn("type", F.col("type").cast("int"))
    both = nodes.select("package").distinct().join(edges.select("package").distinct(), "package")
    nodes = nodes.join(both, "package", "left_semi")
    edges = edges.join(both, "package", "left_semi")
    return nodes.select("package", "node", "source_code", "description", "signature"), \
        edges.select("package", "node1", "node2", "type")


# S7 -------------------------------------------------------------------------
def require_columns(df: DataFrame, cols) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing column(s) {missing}")
    return df


FUNCTION_BASE_COLUMNS = {"function signature": "signature", "comment": "comment",
                         "raw_source_code": "raw_source_code", "embeddings": "embeddings"}


def read_function_base(spark: SparkSession, root: str, name: str = "function_base.csv", check: bool = True) -> DataFrame:
    """``dataset_name, signature, comment, raw_source_code, embeddings`` of every
    dataset folder, each file read by its header; a file without the code
    column raises, other absent columns are null.  ``name`` may be a pattern."""
    columns = {to: c for c, to in FUNCTION_BASE_COLUMNS.items()}
    df = _headed(spark, f"{root.rstrip('/')}/*/{name}", check, columns=columns, required=["raw_source_code"])
    return df.select(parent_folder(F.col("_file")).alias("dataset_name"), *FUNCTION_BASE_COLUMNS.values())


# S8 -------------------------------------------------------------------------
VARIANTS = ("context_generation", "no_context_generation", "simple_generation")


def read_results(spark: SparkSession, root: str, pattern: str = "*/*.csv", variants: tuple[str, ...] = VARIANTS,
                 check: bool = True) -> DataFrame:
    """Every ``*.csv`` of every dataset folder in long form:
    ``dataset_name, file, signature, reference, variant, candidate``.

    Columns are found by each file's header: ``source code`` (or, in older
    files, ``ground_truth``) is the reference, ``function signature`` the
    signature if there is one, and each column named in ``variants`` gives a row.
    Other columns, such as an index, are left out.  A file without a reference
    or without any variant raises.
    """
    df = _headed(spark, f"{root.rstrip('/')}/{pattern}", check, required=["reference"], each=list(variants),
                 columns={"reference": ["source code", "ground_truth"], "signature": "function signature"})
    return df.select(parent_folder(F.col("_file")).alias("dataset_name"), file_stem(F.col("_file"), ".csv").alias("file"),
                     "signature", "reference", F.explode("each").alias("variant", "candidate"))


# S9 -------------------------------------------------------------------------
def read_metrics(spark: SparkSession, root: str, pattern: str = "*/metrics/*.json", layout: str = "folders") -> DataFrame:
    """``dataset_name, file, metric, value`` of every JSON object of metrics.

    ``layout='folders'``: ``<dataset>/metrics/<file>.json``; ``'partitioned'``:
    the layout of :func:`codeloom.sources.writers.write_metrics`.  The objects
    may have any keys and any line breaks; a file that is not one object of
    numbers raises.
    """
    if layout not in ("folders", "partitioned"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout == "partitioned":
        pattern = "*/*/part-*"
    raw = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True).select("value", _path_col().alias("_path"))
    found = F.from_json(F.trim("value"), "map<string, double>", {"mode": "PERMISSIVE"})
    raw = raw.withColumn("_m", F.coalesce(found, F.raise_error(F.concat(F.lit("not an object of metrics: "), F.col("_path")))))
    path = F.col("_path")
    name = file_stem(path, ".json") if layout == "folders" else parent_folder(path)
    return raw.select(parent_folder(path, up=2).alias("dataset_name"), name.alias("file"), F.explode("_m").alias("metric", "value"))


# S10 ------------------------------------------------------------------------
def pending_packages(all_packages: DataFrame, done: DataFrame, key: str = "package") -> DataFrame:
    """Packages without output yet (incremental batch selection)."""
    return all_packages.join(done.select(key).distinct(), key, "left_anti")
