"""Writers of results: tables by Spark, small summaries by the driver."""

from __future__ import annotations

import csv
import io
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing path is an error unless it may be overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> None:
    """Parquet, partitioned by columns where given."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_with_failures(df: DataFrame, failed: str, path: str, failures: str, by: list[str]) -> None:
    """All rows partitioned (one folder per model and seed), and the failed ones beside them."""
    write_parquet(df, path, by=by)
    back = df.sparkSession.read.parquet(path)
    write_parquet(back.where(failed), failures, by=by)


def summary_rows(df: DataFrame, most: int = 10_000) -> list[dict[str, Any]]:
    """Rows of a small summary; more than ``most`` are refused, not cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a summary of more than {most} rows; write it as a table")
    return rows


def write_summary_json(value: Any, path: str) -> None:
    """Nested summary or run manifest, readable."""
    _into(path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def write_manifest(spark: SparkSession, value: Any, path: str) -> None:
    """Summary or manifest as one JSON document in a folder on any file system Spark reaches."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """Wide metric table as one CSV file."""
    out = io.StringIO()
    w = csv.DictWriter(out, df.columns)
    w.writeheader()
    w.writerows(summary_rows(df))
    _into(path, out.getvalue())


def markdown_table(df: DataFrame) -> str:
    """Small table as Markdown."""
    rows = summary_rows(df)
    cell = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(r[c]) for c in df.columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def _into(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
