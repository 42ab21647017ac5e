"""Digests of files of any size, read range by range.

Spark's binary source puts a whole file into one cell, at most 2 GB and all of it in an
executor's memory. Here Spark lists the files, and each task streams its own in ranges of a
fixed size through a running SHA-256. A task holds one range, whatever the size of the file, and
sends back one row. A lost executor costs the files that it was reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes of a file that are in memory at a time.
RANGE_BYTES = 8 << 20
#: Files up to this size are hashed inside the JVM, as one cell.
CELL_BYTES = 32 << 20
#: Largest cell that Spark can hold.
MOST_CELL_BYTES = 2_000_000_000
#: File systems that Python tasks can open, and the names these go by there.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path as Spark's binary source lists it (not escaped)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest, safe='/:@')}")
    return system, unquote(inner)


def read_ranges(path: str, size: int = RANGE_BYTES) -> Iterator[bytes]:
    """The bytes of a file in order, at most ``size`` at a time."""
    system, inner = _located(path)
    with system.open_input_file(inner) as file:
        while part := file.read(size):
            yield part


def file_digests(spark: SparkSession, paths, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(path, length, sha256) of every file under ``paths`` (a path, a pattern or a list of them).

    Files over ``cell_bytes`` are read in ranges, with equal results. Only on a file system that
    Python tasks can't open (not one of SCHEMES) every file is a cell, and sha256 is NULL beyond
    the 2 GB that a cell can hold. A file that changes while it is read, so that the bytes are not
    as many as were listed, fails its task. Spark lists no empty files, so they have no row.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    ranged = (F.col("length") > cell_bytes) & F.substring_index("path", ":", 1).isin(*SCHEMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path, length in zip(rb.column("path").to_pylist(), rb.column("length").to_pylist()):
                running, n = hashlib.sha256(), 0
                for part in read_ranges(path):
                    running.update(part)
                    n += len(part)
                if n != length:
                    raise OSError(f"{path} has changed: {n} bytes read, {length} listed")
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "sha256": [running.hexdigest()]})

    long = files.filter(ranged).select("path", "length").mapInArrow(run, "path string, length bigint, sha256 string")
    rest = files.filter(~ranged)
    cells = rest.filter(F.col("length") <= MOST_CELL_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    beyond = rest.filter(F.col("length") > MOST_CELL_BYTES).select("path", "length", F.lit(None).cast("string").alias("sha256"))
    return long.unionByName(cells).unionByName(beyond)
