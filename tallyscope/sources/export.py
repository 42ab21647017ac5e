"""Export bundle as one output directory written by Spark.

Tables, row issues and the status of each method are written as CSV part-file directories
(complex columns as JSON text). The JSON documents and the report are single text files,
written through Spark too, so the whole bundle lands on the shared filesystem.
"""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from datetime import date
from enum import Enum
from functools import singledispatch
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import Ingestion
from ..operators.scope import flagged_records
from ..plans.workflow import AnalysisRun

BUNDLE = (
    "validated_input", "analysis_results", "excluded_records", "flagged_diagnostics", "validation_issues",
    "run_metadata.json", "method_diagnostics.json", "validation_report.json", "report.md", "tables.json",
)
KIND = "tallyscope.bundle"


@singledispatch
def json_default(value: Any) -> Any:
    """What ``json`` cannot write by itself."""
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    raise TypeError(f"no JSON form for {type(value).__name__}")


json_default.register(Enum, lambda v: v.value)
json_default.register(date, lambda v: v.isoformat())  # datetimes too
json_default.register(np.generic, lambda v: v.item())
json_default.register(np.ndarray, lambda v: v.tolist())
json_default.register(frozenset, sorted)


def _csv_ready(df: DataFrame) -> DataFrame:
    nested = {n for n, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    return df.select(*[(F.to_json(F.col(f"`{n}`")) if n in nested else F.col(f"`{n}`")).alias(n) for n in df.columns])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_report(run: AnalysisRun) -> str:
    """A table of the methods under the figures of the run."""
    m = run.metadata
    figures = {"Candidate": m["candidate_label"], "Rows analysed": m["analysis_rows"], "Rows excluded": m["excluded_rows"], "Rows read": m["input_rows"]}
    head = "# Returns analysis\n\n" + "".join(f"* {k}: {v}\n" for k, v in figures.items())
    table = "| method | state | message |\n|-|-|-|\n" + "".join(f"| {k} | {s.state} | {s.message} |\n" for k, s in run.statuses.items())
    return f"{head}\n{table}\n{m['notice']}\n"


def write_bundle(ingestion: Ingestion, run: AnalysisRun, out_dir: str) -> list[str]:
    """Write the bundle members under ``out_dir``; returns their paths."""
    spark = run.data.sparkSession
    tables = {
        "validated_input": ingestion.accepted,
        "analysis_results": run.data,
        "excluded_records": ingestion.excluded,
        "flagged_diagnostics": flagged_records(run.data),
        "validation_issues": ingestion.issues,
    }
    documents = {
        "run_metadata.json": {k: v for k, v in run.metadata.items() if not k.startswith("_")},
        "method_diagnostics.json": run.diagnostics,
        "validation_report.json": {"report": ingestion.report(), "file_issues": ingestion.file_issues, "sources": run.metadata["provenance"]["files"]},
    }
    for name, df in tables.items():
        out = _csv_ready(df).write.mode("overwrite").option("header", True).option("quote", "\"").option("escape", "\"")
        # white space is part of a value
        out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{out_dir}/{name}")
    documents["tables.json"] = {"kind": KIND, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}}
    for name, doc in documents.items():
        _write_text(spark, f"{out_dir}/{name}", json.dumps(doc, indent=2, default=json_default, ensure_ascii=False))
    _write_text(spark, f"{out_dir}/report.md", markdown_report(run))
    return [f"{out_dir}/{name}" for name in BUNDLE]


def read_bundle(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of a bundle with the types that they were written with; refuses any other directory."""
    try:
        listed = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{out_dir}/tables.json").collect()))
    except AnalysisException as exc:
        raise ValueError(f"{out_dir} holds no bundle") from exc
    if listed.get("kind") != KIND:
        raise ValueError(f"{out_dir} holds no bundle")
    found = {}
    for name, spec in listed["tables"].items():
        schema = T.StructType.fromJson(spec)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        # a field without quotes and content is NULL, a quoted one an empty text
        rows = spark.read.schema(text).option("nullValue", "\0").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(f"{out_dir}/{name}")
        columns = []
        for f in schema.fields:
            c, plain = F.col(f"`{f.name}`"), not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)
            columns.append((c.cast(f.dataType) if plain else F.from_json(c, f.dataType)).alias(f.name))
        found[name] = rows.select(*columns)
    return found
