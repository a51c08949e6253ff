"""Hashes and headers of files, worked out in tasks that stream each file in fixed chunks."""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file held at once.
CHUNK = 1 << 22
#: Bytes read at a time while the end of a header line is looked for.
HEAD_CHUNK = 1 << 14
#: Path schemes that tasks open by themselves.
STREAMED = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _scheme(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    scheme = _scheme(path)
    if scheme not in STREAMED:
        raise ValueError(f"tasks cannot open {path}; schemes: {', '.join(s for s in STREAMED if s)}")
    if not scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _members(fs: pafs.FileSystem, inner: str) -> list[pafs.FileInfo]:
    """The file itself, or the data files under a folder by path."""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(inner)
    if info.type != pafs.FileType.Directory:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((i for i in found if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)


def _digest(path: str) -> list[tuple[str, int, str]]:
    fs, inner = _opened(path)
    out = []
    for info in _members(fs, inner):
        running, size = hashlib.sha256(), 0
        with fs.open_input_stream(info.path, compression=None) as stream:
            while chunk := stream.read(CHUNK):
                running.update(chunk)
                size += len(chunk)
        out.append((info.path, size, running.hexdigest().upper()))
    return out


def _header(path: str) -> list[tuple[str, str, str, list[str], bool]]:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
    names: list[str] = []
    try:
        if suffix in (".parquet", ".pq"):
            fs, inner = _opened(path)
            with fs.open_input_file(_members(fs, inner)[0].path) as file:
                names = pq.read_schema(file).names
        elif suffix in (".csv", ".gz"):
            fs, inner = _opened(path)
            line = bytearray()
            with fs.open_input_stream(inner, compression="gzip" if suffix == ".gz" else None) as stream:
                while b"\n" not in line and (chunk := stream.read(HEAD_CHUNK)):
                    line += chunk
            text = line.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
            names = next(csv.reader([text]), []) if text.strip() else []
        else:
            return [(path, name, suffix, [], True)]
    except (OSError, ValueError, IndexError, pa.ArrowException):  # an unreadable file is a finding, not a failure
        names = []
    return [(path, name, suffix, names, bool(names))]


def _each(paths: DataFrame, fn: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn`` for every distinct path, files dealt over the cores."""
    spark = paths.sparkSession
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = fn(path)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if c[0] != [] else pa.array(c, pa.list_(pa.string())) for c in map(list, zip(*found))], names=names)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.select("path").where("path is not null").distinct().repartition(tasks).mapInArrow(run, schema)


def _table(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    return paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")


def file_hashes(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path, bytes, sha256 in upper case) of each distinct file, or of each data file of a folder.

    ``paths`` is a list or a table with a column ``path``. A file is streamed in chunks of CHUNK bytes into a running
    digest, so its size does not matter; a missing file fails the read. Paths of a list that only Spark can open are
    read whole by Spark, up to 2 GB each.
    """
    schema = "path string, bytes long, sha256 string"
    if isinstance(paths, DataFrame) or all(_scheme(p) in STREAMED for p in paths):
        return _each(_table(spark, paths), _digest, schema)
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    return files.select("path", F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def file_headers(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path, file_name, suffix, header, readable) of each distinct uploaded file.

    A task reads the first line of a text file or the footer of a Parquet file. Files that are absent, empty or broken
    are not readable; files of other suffixes are not opened. ``paths`` is a list or a table with a column ``path``.
    """
    return _each(_table(spark, paths), _header, "path string, file_name string, suffix string, header array<string>, readable boolean")
