import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources import readers, writers
from quillmill.streaming import logs

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "name": "x"}\n\n   \n{"id": 2}\n')
    assert sorted(tuple(r) for r in readers.jsonl_strict(spark, str(p), SCHEMA).collect()) == [(1, "x"), (2, None)]
    p.write_text('{"id": 1, "name": "x"}\n{bad\n[1]\n{"id": 3, "name": " "}\n')
    with pytest.raises(Exception, match="bad JSON line"):
        readers.jsonl_strict(spark, str(p), SCHEMA).collect()
    assert [tuple(r) for r in readers.jsonl_lenient(spark, str(p), SCHEMA, ["name"]).collect()] == [(1, "x")]
    assert readers.jsonl_or_empty(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_arrays_csv_and_keywords(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]))
    assert readers.json_array(spark, str(tmp_path / "s.json"), SCHEMA).count() == 2
    d = tmp_path / "c"
    d.mkdir()
    for n in ("x_prompts_seed0_examples0.csv", "no-story_prompts_seed0_examples0.csv", "other.csv"):
        (d / n).write_text('prompt,id\n"two\nlines, ""quoted""",1\n')
    got = readers.csv_directory(spark, str(d)).collect()
    assert [(r["prompt"], r["id"], r["file"]) for r in got] == [('two\nlines, "quoted"', "1", "x_prompts_seed0_examples0.csv")]
    with pytest.raises(ValueError):
        readers.csv_file(spark, "https://example.org/x.csv")
    (tmp_path / "k.txt").write_text("- Fish\n2. Tram\nfish\n")
    assert [r["keyword"] for r in readers.keyword_file(spark, str(tmp_path / "k.txt")).collect()] == ["Fish", "Tram"]


def test_paths_and_settings(tmp_path):
    for n in ("checkpoint-20", "checkpoint-3", "checkpoint-x", "final"):
        (tmp_path / n).mkdir()
    assert [p.rsplit("-", 1)[1] for p in readers.checkpoints(str(tmp_path))] == ["3", "20"] and len(readers.checkpoints(str(tmp_path), 10)) == 1
    assert readers.first_existing([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    (tmp_path / "c.yaml").write_text('{"a": {"b": 1}}')
    c = readers.yaml_config(str(tmp_path / "c.yaml"))
    assert readers.setting(c, "a.b") == 1 and readers.setting(c, "a.x", 5) == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, True), ("m", 2, False), ("n", 1, True)], "model string, seed int, ok boolean")
    writers.write_jsonl(df, str(tmp_path / "j"))
    with pytest.raises(Exception):
        writers.write_jsonl(df, str(tmp_path / "j"))
    writers.write_jsonl(df, str(tmp_path / "j"), overwrite=True)
    writers.write_with_failures(df, "not ok", str(tmp_path / "all"), str(tmp_path / "failed"), ["model", "seed"])
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 1 and (tmp_path / "all" / "model=m" / "seed=2").is_dir()
    writers.write_summary_csv(df.orderBy("model", "seed"), str(tmp_path / "s" / "x.csv"))
    assert (tmp_path / "s" / "x.csv").read_text().splitlines()[:2] == ["model,seed,ok", "m,1,True"]
    writers.write_summary_json({"a": [1]}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": [1]}
    assert writers.markdown_table(df.limit(1)).startswith("| model | seed | ok |\n| --- |")
    with pytest.raises(ValueError):
        writers.summary_rows(df, 2)


def test_positions_and_names(spark):
    df = spark.createDataFrame([("f1", 3, " "), ("f1", 1, None), ("f0", 9, "x")], "file string, at int, name string").repartition(3)
    got = readers.with_pos(df, ["file", "at"])
    assert sorted((r["pos"], r["file"], r["at"]) for r in got.collect()) == [(1, "f0", 9), (2, "f1", 1), (3, "f1", 3)]
    assert readers.first_name(got, "name", "pos", "stem").first()["name"] == "x"
    assert readers.first_name(got.where("name is null"), "name", "pos", "stem").first()["name"] == "stem"
    assert [r["pos"] for r in readers.last_rows(got, "pos", 2).collect()] == [2, 3]


def test_streams_add_every_record_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(30).select(F.col("id").alias("log_no"), F.timestamp_seconds(F.col("id") * 3600).alias("logged_at"))
    rows.union(rows.limit(5)).write.parquet(src)
    log = logs.read_log(spark, src, rows.schema)
    for _ in range(2):  # the second run finds nothing new
        logs.append_pending(log, "log_no", out, str(tmp_path / "cp")).awaitTermination()
    logs.append_pending(log, "log_no", out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 30
    q = logs.windowed(logs.once_per_key(log, "log_no", "logged_at"), "logged_at", []).writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from w").count() >= 0


def test_late_rows_are_counted(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [0, 20, 21, 1, 80, 81, 2]  # one batch each: day 1 is 20 days late, day 2 is 79
    for k, day in enumerate(days):
        row = spark.range(k, k + 1, 1, 1).select(F.col("id").alias("log_no"), F.timestamp_seconds(F.lit(day * 86400 + 60)).alias("logged_at"))
        row.write.mode("append").parquet(src)
        time.sleep(0.1)
    log = logs.read_log(spark, src, row.schema, 1)
    q = logs.windowed(log, "logged_at", []).writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["d"] for r in spark.sql("select datediff(window.start, date'1970-01-01') d from late").collect()) == [0, 1, 20, 21]
    logs.append_pending(log, "log_no", out, str(tmp_path / "cp")).awaitTermination()
    got = logs.counted(spark.read.parquet(out), "logged_at", []).selectExpr("datediff(window.start, date'1970-01-01') d", "n").collect()
    assert sorted((r["d"], r["n"]) for r in got) == [(d, 1) for d in sorted(days)]
