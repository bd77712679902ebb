"""Sinks and report files: JSON lines with their count, evaluation reports, tables for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The order of configurations in a report.
CONFIGS = ["no_retrieval", "simple_retrieval", "full_no_decompose", "full"]


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Writes JSON lines and returns their number, which is counted while they are written. Null fields are written as null."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").mode("overwrite").json(path)
    return seen.get["n"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """One JSON document, one line, through Spark's writer, so that the path may be in any store."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, pattern: str, table: str = "generation_configs") -> DataFrame:
    """(file, row): the rows of a table in the reports that match, by configuration in its usual order, then file and place."""
    files = spark.read.text(pattern, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.get_json_object("value", f"$.{table}.table").alias("t"))
    rows = files.select("file", F.posexplode(F.from_json("t", "array<map<string,string>>")).alias("place", "row"))
    rank = F.array_position(F.array(*(F.lit(c) for c in CONFIGS)), F.element_at("row", "config"))
    return rows.withColumn("k_", F.when(rank > 0, rank).otherwise(99)).orderBy("k_", "file", "place").drop("k_")


def markdown_table(rows: list[dict]) -> str:
    """A table of the first row's columns; ``_(none)_`` for no rows."""
    if not rows:
        return "_(none)_"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cols = list(rows[0])
    return "\n".join([line(cols), "|" + "---|" * len(cols), *(line([str(r.get(c, "")) for c in cols]) for r in rows)])


def fixed_table(rows: list[dict], title: str = "") -> str:
    """Columns padded to their widest cell, numbers to the right."""
    if not rows:
        return title
    cols = list(rows[0])
    cells = [cols, *([str(r.get(c, "")) for c in cols] for r in rows)]
    wide = [max(len(row[i]) for row in cells) for i in range(len(cols))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(row, wide, strict=True)) for row in cells]
    return "\n".join([*([title] if title else []), lines[0], "  ".join("-" * w for w in wide), *lines[1:]])


def report_rows(rows: DataFrame, most: int = 10_000) -> list[dict]:
    """A small result for a report; more than ``most`` rows are an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report takes at most {most} rows")
    return [r.asDict() for r in found]
