"""JSON lines, JSON documents and tables: sources, sinks and checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """One record a line; the schema is given, never guessed. A line that does not parse fails the read.

    ``line`` is the order of ingestion, whatever task reads a file: files by
    time of writing, then path, lines by place in their file. ``limit`` keeps
    the first lines.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # within a block of a file, numbers rise in order of reading
    place = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    rows = rows.withColumn("line", F.struct(*place, F.monotonically_increasing_id().alias("row")))
    return rows if limit is None else rows.orderBy("line").limit(limit)


def read_sheets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_jsonl(spark, path, schemas.SHEET, limit)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.QUERY)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extractions by id; the last line of an id wins."""
    return last_wins(read_jsonl(spark, path, schemas.EXTRACTION), ["id"], "line")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key's rows, that which is last in order."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", nulls: bool = True) -> None:
    """UTF-8 JSON lines; null fields are written as such, or left out."""
    rows.write.mode(mode).option("ignoreNullFields", not nulls).json(path)


def remaining(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not done yet, which a resumed job has left."""
    return rows.join(done.select(key), key, "left_anti")


def append_remaining(rows: DataFrame, path: str, work, schema: T.StructType, key: str = "id") -> int:
    """Applies ``work`` to the rows that ``path`` does not hold yet and appends the results; rows appended."""
    spark = rows.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if known:
        done = spark.read.schema(schema).json(path)
        before = done.count()
        rows = remaining(rows, done, key)
    else:
        before = 0
    write_jsonl(work(rows), path, "append")
    return spark.read.schema(schema).json(path).count() - before


def require_complete(rows: DataFrame, done: DataFrame, key: str = "id", named: int = 3) -> None:
    """Fails if a row's key is not done, with the count and the first keys."""
    missing = remaining(rows, done, key).select(key)
    if first := [r[0] for r in missing.orderBy(key).limit(named).collect()]:
        raise ValueError(f"{missing.count()} rows have no extraction yet, such as {first}")


def read_document(path: str) -> dict:
    """A JSON document on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_document(value: dict, path: str) -> None:
    """A JSON document from the driver: a report, which is small."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Creates or replaces a table of files, in folders by a column; returns it as read again."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_text_table(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t", null: str = "\\N") -> DataFrame:
    """A table in lines of separated text, as bulk loads take; a line that does not fit fails the read."""
    return spark.read.schema(schema).options(sep=separator, nullValue=null, mode="FAILFAST", quote="", escape="").csv(path)


def require(rows: DataFrame, key: list[str] | None = None, not_null: list[str] = (), parent: tuple[list[str], DataFrame] | None = None) -> DataFrame:
    """``rows`` as they are, if they keep the constraints of a table; else an error that names the first broken one.

    ``key`` is unique and not null, ``not_null`` columns are filled, and the
    first columns of ``parent`` occur in its frame's columns of the same place.
    One pass counts nulls, one grouped count finds repeated keys.
    """
    filled = [*(key or []), *(c for c in not_null if c not in (key or []))]
    if filled:
        nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled]).first()
        if broken := [c for c in filled if nulls[c]]:
            raise ValueError(f"{nulls[broken[0]]} rows have no {broken[0]}")
    if key and (twice := rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").orderBy(*key).first()):
        raise ValueError(f"{twice['__n']} rows have the key {tuple(twice[c] for c in key)}")
    if parent:
        columns, frame = parent
        named = frame.toDF(*[f"__p{i}" for i in range(len(frame.columns))])
        same = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)]
        if lost := rows.where(F.concat(*[F.col(c).cast("string") for c in columns]).isNotNull()).join(named, same, "left_anti").first():
            raise ValueError(f"{tuple(lost[c] for c in columns)} has no parent")
    return rows


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with bound values; names of columns come from callers' own lists, never from input."""
    return spark.sql(sql, args=args or {}, **frames)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database, where one is used beside files."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def analyze(spark: SparkSession, name: str) -> None:
    """Statistics of a catalogued table, for the cost-based planner."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def explained(rows: DataFrame, mode: str = "formatted") -> str:
    """The plan as text, with vector literals cut short."""
    import re

    text = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return re.sub(r"\[(?:-?\d+\.\d+(?:E-?\d+)?,\s*){8,}[^\]]*\]", "[...]", text)
