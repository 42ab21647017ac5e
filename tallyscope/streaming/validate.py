"""Row validation on a streaming DataFrame.

The reference reads one finite file; it has no streams. The row rules are
stateless column expressions, so the same ingestion plan also runs on a
Structured Streaming source (e.g. new returns files landing in a folder).
Only the duplicate-key rule (V7) needs the whole table; it is left to the batch
path, and ``validate_stream`` says so in the returned Ingestion's file issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Ingestion, ingest
from ..schema import ContestSchema, Settings


def validate_stream(stream: DataFrame, schema: ContestSchema, settings: Settings | None = None, row_key: str | None = None) -> Ingestion:
    """Apply P3-P13 and V6, V8-V18 to a streaming returns DataFrame."""
    if not stream.isStreaming:
        raise ValueError("validate_stream expects a streaming DataFrame")
    return ingest(stream, schema, settings, row_key=row_key, streaming=True)


def start_issue_sink(ing: Ingestion, checkpoint: str, path: str, sink: str = "parquet") -> StreamingQuery:
    """Append the long issues table of a validated stream to files under ``path``."""
    return ing.issues.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format(sink).option("path", path).start()
