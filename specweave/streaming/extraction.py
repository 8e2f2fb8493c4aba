"""Resumable extraction as a stream over a folder of sheets.

Each file of sheets is extracted once; the checkpoint remembers what is done,
so a stopped job goes on where it was. Results and failures are appended as
JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave import schemas
from specweave.operators import extract
from specweave.sources.jsonl import write_jsonl
from specweave.workspace import Workspace


def extract_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, failures: str | None = None, provider=extract.alias_mapper, files_per_batch: int = 1):
    """Starts the stream; it ends when every file that is there has been extracted."""

    def batch(sheets: DataFrame, _: int) -> None:
        with Workspace(spark, "stream") as ws:
            sheets = ws.stage(sheets, "sheets")
            mapped = ws.stage(extract.map_headers(sheets, provider), "mapped")  # a provider is asked once
            write_jsonl(extract.extracted(sheets, mapped), out, "append")
            if failures:
                write_jsonl(mapped.where(F.col("mapping").isNull()).select("id", "failure"), failures, "append")

    stream = spark.readStream.schema(schemas.SHEET).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
