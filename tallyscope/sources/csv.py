"""CSV returns sources with per-file encoding detection and provenance.

One distributed scan of the lines decides everything per file: the encoding (S2), the
header line, and whether a quoted field runs over a line end. Lines that are not valid
UTF-8 make a file cp1252, or latin-1 if one of them has a byte that cp1252 leaves undefined.
Files of equal encoding, header and line mode are read together and unioned by name, so
files may order their columns differently. Quoting is that of RFC 4180: quotes inside a
quoted field are doubled, and a quoted field may hold line breaks (only files that have an
odd number of quotes in some line pay for the unsplittable reader).

Every column is read as STRING (S1); a trailing ``_overflow`` column catches rows longer than
the header (S5, malformed). Duplicate header names (S6) are checked on every distinct header,
because Spark would silently rename them.
"""

from __future__ import annotations

import csv as _csv
import io
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ingest import DataValidationError
from ..session import ensure_checkpoint_dir
from .ranges import CELL_BYTES, file_digests

# Candidate encodings in the order tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
_SPARK_CHARSET = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
# Bytes with no cp1252 character, as a regex over a line's hex digits.
_CP1252_UNDEFINED_HEX = "^(..)*?(81|8D|8F|90|9D)"
OVERFLOW = "_overflow"


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def file_sizes(spark: SparkSession, paths) -> DataFrame:
    """(path, length) per file; selecting only ``length`` never reads file contents."""
    return spark.read.format("binaryFile").load(_as_list(paths)).select(F.col("_metadata.file_path").alias("path"), "length")


class CsvFile(NamedTuple):
    path: str
    encoding: str
    multiline: bool
    header: tuple[str, ...]


def scan_files(spark: SparkSession, paths) -> list[CsvFile]:
    """Encoding, line mode and header of every file (one small row per file comes back).

    The text source keeps each line's raw bytes, so ``is_valid_utf8`` sees undecodable bytes and
    the line's hex shows bytes undefined in cp1252. Line readers drop a UTF-8 byte-order mark, so
    a file with one reports "utf-8" (its decoded content is the same as under utf-8-sig).
    """
    raw = spark.read.text(_as_list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        "value", F.monotonically_increasing_id().alias("line"))
    undefined = F.hex(F.col("value").cast("binary")).rlike(_CP1252_UNDEFINED_HEX)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = raw.groupBy("path").agg(
        F.count_if(~F.is_valid_utf8("value")).alias("bad"),
        F.count_if(~F.is_valid_utf8("value") & undefined).alias("undefined"),
        F.count_if(quotes % 2 == 1).alias("odd"),
        F.min_by(F.col("value").cast("binary"), F.struct("block", "line")).alias("first"),
    ).collect()
    files = []
    for r in found:
        encoding = "utf-8" if r["bad"] == 0 else "cp1252" if r["undefined"] == 0 else "latin-1"
        line = bytes(r["first"] or b"").decode(encoding, "replace").lstrip("\ufeff")
        if line.count('"') % 2:  # a header name holds a line break
            got = _reader(spark, encoding, True).option("header", False).csv(r["path"]).limit(1).collect()
            names = [n or "" for n in got[0]]
        else:
            names = next(_csv.reader(io.StringIO(line)), [])
        files.append(CsvFile(r["path"], encoding, r["odd"] > 0, tuple(names)))
    return files


def detect_encodings(spark: SparkSession, paths) -> dict[str, str]:
    """Encoding per file."""
    return {f.path: f.encoding for f in scan_files(spark, paths)}


def _reader(spark: SparkSession, encoding: str, multiline: bool) -> DataFrameReader:
    if encoding == "cp1252":
        # windows-1252 is only accepted by the CSV reader with Java charsets enabled.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (spark.read.option("encoding", _SPARK_CHARSET[encoding]).option("mode", "PERMISSIVE")
            .option("quote", '"').option("escape", '"').option("multiLine", multiline))


def _schema(header: tuple[str, ...]) -> StructType:
    return StructType([StructField(h, StringType()) for h in header] + [StructField(OVERFLOW, StringType())])


def read_returns_csv(spark: SparkSession, paths, max_bytes: int | None = None) -> tuple[DataFrame, dict]:
    """Read CSV returns as all-STRING columns; returns (frame, per-file encodings)."""
    paths = _as_list(paths)
    try:
        sizes = file_sizes(spark, paths)
        sizes.limit(1).count()
    except Exception as exc:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise FileNotFoundError(f"Data file not found: {paths}") from exc
        raise
    if max_bytes is not None:
        too_big = file_sizes(spark, paths).filter(F.col("length") > max_bytes).collect()
        if too_big:
            raise DataValidationError(f"{too_big[0]['path']} has {too_big[0]['length']} bytes, over the limit of {max_bytes}")
    if spark.read.format("binaryFile").load(paths).filter(F.col("length") > 0).select("path").limit(1).count() == 0:
        raise DataValidationError("CSV without content")
    files = scan_files(spark, paths)
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault((f.encoding, f.multiline, f.header), []).append(f.path)
    frames = []
    for (encoding, multiline, header), members in groups.items():
        if not any(header):
            raise DataValidationError(f"No column names in the first line of {members[0]}")
        twice = sorted({h for h in header if header.count(h) > 1})
        if twice:
            raise DataValidationError(f"Columns named more than once in {members[0]}: {', '.join(twice)}")
        frames.append(_reader(spark, encoding, multiline).schema(_schema(header)).option("header", True).csv(members))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if out.filter(F.col(OVERFLOW).isNotNull()).limit(1).count():
        raise DataValidationError("CSV row with more fields than its header")
    out = out.drop(OVERFLOW)
    if out.isEmpty():
        raise DataValidationError("CSV without data rows")
    return out, {f.path: f.encoding for f in files}


FILE_ISSUE = "path string, code string, message string"


def file_issues(spark: SparkSession, paths, max_bytes: int | None = None, required: list[str] | None = None) -> DataFrame:
    """V1-V4 / S4-S6 as a table: (path, code, message) for every file that cannot be read, in one scan of all files.

    Codes: empty_file, file_too_large, duplicate_columns, unsupported_column_mapping (``required`` columns
    that the header lacks), empty_dataset, malformed_csv. A file has one row per code; good files have none.
    """
    paths = _as_list(paths)
    sized = file_sizes(spark, paths)
    # readers pass empty files over, so they are those that are listed and not read
    listed = spark.createDataFrame([(p,) for p in spark.read.format("binaryFile").load(paths).inputFiles()], "path string")
    one_form = F.regexp_replace("path", "^file:/+", "file:/")  # listings and readers write local paths differently
    empty = listed.join(sized.filter("length > 0").select(one_form.alias("form")), one_form == F.col("form"), "left_anti")
    found = empty.select("path", F.lit("empty_file").alias("code"), F.lit("no content").alias("message"))
    if max_bytes is not None:
        over = F.concat(F.col("length").cast("string"), F.lit(f" bytes, over the limit of {max_bytes}"))
        found = found.unionByName(sized.filter(F.col("length") > max_bytes).select("path", F.lit("file_too_large").alias("code"), over.alias("message")))
    rows, groups = [], {}
    for f in scan_files(spark, paths):
        twice = sorted({h for h in f.header if f.header.count(h) > 1})
        missing = sorted(set(required or ()) - set(f.header))
        if twice:
            rows.append((f.path, "duplicate_columns", f"named more than once: {', '.join(twice)}"))
        if missing:
            rows.append((f.path, "unsupported_column_mapping", f"not in the header: {', '.join(missing)}"))
        if any(f.header) and not twice:
            groups.setdefault((f.encoding, f.multiline, f.header), []).append(f.path)
    # one row per file and finding, as the scan's own
    found = found.unionByName(spark.createDataFrame(rows, FILE_ISSUE))
    for (encoding, multiline, header), members in groups.items():
        listed = _reader(spark, encoding, multiline).schema(_schema(header)).option("header", True).csv(members)
        counted = listed.select(F.col("_metadata.file_path").alias("path"), F.col(OVERFLOW).isNotNull().alias("long")).groupBy("path").agg(
            F.count("*").alias("rows"), F.count_if("long").alias("long"))
        every = spark.createDataFrame([(m,) for m in members], "path string").join(counted, "path", "left")
        found = found.unionByName(every.filter("rows IS NULL").select("path", F.lit("empty_dataset").alias("code"), F.lit("a header without rows").alias("message")))
        more = F.concat(F.col("long").cast("string"), F.lit(" rows with more fields than the header"))
        found = found.unionByName(every.filter("long > 0").select("path", F.lit("malformed_csv").alias("code"), more.alias("message")))
    return found


def read_good_files(spark: SparkSession, paths, max_bytes: int | None = None, required: list[str] | None = None) -> tuple[DataFrame | None, dict, DataFrame]:
    """(frame of the files without an issue or None, their encodings, the issues of the others)."""
    issues = file_issues(spark, paths, max_bytes, required).persist()
    bad = {r["path"] for r in issues.select("path").distinct().collect()}
    good = [r["path"] for r in file_sizes(spark, paths).select("path").collect() if r["path"] not in bad]
    if not good:
        return None, {}, issues
    frame, encodings = read_returns_csv(spark, good)
    return frame, encodings, issues


def stored_text(spark: SparkSession, source, max_bytes: int | None = None) -> str:
    """S3: the path of a CSV given as bytes, text or an open file, written to the shared folder as UTF-8.

    Bytes are decoded by the first of ENCODINGS that fits. The payload is a driver value, so it is small.
    """
    payload = source.read() if hasattr(source, "read") else source
    if max_bytes is not None and len(payload) > max_bytes:
        raise DataValidationError(f"the payload has {len(payload)} bytes, over the limit of {max_bytes}")
    if isinstance(payload, bytes):
        for encoding in ENCODINGS:
            try:
                payload = payload.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
    if not payload.strip():
        raise DataValidationError("CSV without content")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/payload-{uuid.uuid4().hex}"
    spark.createDataFrame([(payload.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
    return path


def provenance(spark: SparkSession, paths, encodings: dict[str, str], cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row per file: path, length, SHA-256 of the bytes, encoding, and the digest of its lines.

    SHA-256 is sequential, so one task hashes a file (see ``ranges.file_digests`` for how).
    ``line_digest`` and ``lines`` are computed from all lines, distributed, and do not depend
    on how a file is split.
    """
    hashed = file_digests(spark, paths, cell_bytes)
    lines = spark.read.text(_as_list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    digests = lines.groupBy("path").agg(_digest(F.col("value")).alias("line_digest"), F.count(F.lit(1)).alias("lines"))
    # one row per file, listed by the driver anyway
    known = spark.createDataFrame(list(encodings.items()), "path string, encoding string")
    return hashed.join(known, "path", "left").join(digests, "path", "left")


def _digest(*columns: Column) -> Column:
    """Order-free digest that counts repetitions: decimal sums of two independent hashes."""
    one = F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).cast("string")
    two = F.sum(F.xxhash64(F.lit(2), *columns).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", one, two)


def row_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of all rows and their count (distributed)."""
    return df.agg(_digest(*[F.col(f"`{c}`") for c in df.columns]).alias("digest"), F.count(F.lit(1)).alias("rows"))
