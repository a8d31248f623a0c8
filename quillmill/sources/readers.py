"""Readers of the formats a run takes in. Every reader can add the stable load position ``pos``."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import ustrip

BAD = "_corrupt_record"


def with_pos(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the 1-based load position by the columns that fix it (file, offset or
    id). Ranks come from one distributed sort."""
    from quillmill.operators.ranking import global_rank

    return global_rank(df, [F.col(c) for c in order], "pos")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(ustrip(F.col("value")) != "")


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return _lines(spark, path).select("file", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line ends the read with its file and text."""
    p = _parsed(spark, path, schema)
    where = F.concat(F.lit("bad JSON line in "), F.col("file"), F.lit(": "), F.substr("value", F.lit(1), F.lit(80)))
    checked = p.withColumn("r", F.when(F.col("r").isNull() | F.col("r." + BAD).isNotNull(), F.raise_error(where).cast(T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]))).otherwise(F.col("r")))
    return checked.select(*[F.col("r." + f.name).alias(f.name) for f in schema.fields])


def jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """JSON lines; bad lines, lines that hold no object, and rows that lack a required value are skipped."""
    p = _parsed(spark, path, schema).where(F.col("r").isNotNull() & F.col("r." + BAD).isNull() & F.ltrim("value").startswith("{"))
    rows = p.select(*[F.col("r." + f.name).alias(f.name) for f in schema.fields])
    for c in required or []:
        rows = rows.where(ustrip(F.col(c).cast("string")) != "")
    return rows


def jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or no rows where the file is missing."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
        return spark.createDataFrame([], schema)
    return jsonl_strict(spark, path, schema)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON array in a file, a row per element."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_directory(spark: SparkSession, path: str, pattern: str = "*_prompts_seed0_examples0.csv", exclude: str = "no-story") -> DataFrame:
    """CSV files of a directory by name pattern, names with an excluded part left out; columns as
    text plus ``file``. Quoted values may hold line breaks and doubled quotes."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", pattern).csv(path)
    return df.select("*", F.col("_metadata.file_name").alias("file")).where(~F.col("file").contains(exclude))


def csv_file(spark: SparkSession, path: str) -> DataFrame:
    """One local CSV file with a header; addresses of the network are refused."""
    if re.match(r"(?i)https?://", path):
        raise ValueError("fetch the file first; this reader takes paths only")
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def parquet_by_split(spark: SparkSession, paths: dict[str, str], split: str = "all") -> DataFrame:
    """Parquet per split with a ``split`` column; ``all`` puts every split together by name."""
    names = list(paths) if split == "all" else [split]
    out = None
    for n in names:
        df = spark.read.parquet(paths[n]).withColumn("split", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(keyword) of a file that is a JSON list, an object, JSON lines or plain lines; first spelling of each."""
    from quillmill.functions.parsers import domain_list

    return spark.read.text(path, wholetext=True).select(F.explode(domain_list(F.col("value"))).alias("keyword"))


def yaml_config(path: str) -> dict[str, Any]:
    """Configuration from YAML where a YAML library is installed, else from JSON."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def setting(config: dict[str, Any], path: str, default: Any = None) -> Any:
    """Nested value by a dotted path."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def checkpoints(folder: str, least: int = 0, names: list[str] | None = None) -> list[str]:
    """``checkpoint-N`` folders by step, those below ``least`` or not among ``names`` left out."""
    found = []
    for n in os.listdir(folder):
        m = re.fullmatch(r"checkpoint-(\d+)", n)
        if m and int(m.group(1)) >= least and (names is None or n in names):
            found.append((int(m.group(1)), os.path.join(folder, n)))
    return [p for _, p in sorted(found)]


def first_existing(candidates: list[str]) -> str:
    """First path that exists."""
    for p in candidates:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(candidates))


def last_rows(df: DataFrame, pos: str, n: int) -> DataFrame:
    """Last ``n`` rows by position, in load order."""
    return df.orderBy(F.col(pos).desc()).limit(n).orderBy(pos)


def first_name(df: DataFrame, name: str, pos: str, fallback: str) -> DataFrame:
    """(name): first value that is not blank by position, else the fallback."""
    filled = F.nullif(ustrip(F.col(name)), F.lit(""))
    return df.agg(F.coalesce(F.min_by(filled, F.when(filled.isNotNull(), F.col(pos))), F.lit(fallback)).alias("name"))


