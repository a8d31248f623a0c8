import pytest

from quillmill.pipeline import Config, audit, chosen_stages, run


def test_stages_and_settings(tmp_path):
    c = Config("t", "o", {"split": False})
    assert chosen_stages(c) == ["items", "audit"] and chosen_stages(c, only=["split"]) == ["split"] and chosen_stages(c, skip=["items"]) == ["audit"]
    for bad in ({"stages": {"x": True}}, {"score": "x"}, {"percent": 101}, {"scope": "x"}):
        with pytest.raises(ValueError):
            Config("t", "o", **bad)
    with pytest.raises(ValueError):
        chosen_stages(c, only=["x"])


def test_run(spark, data, tmp_path):
    c = Config(f"{data}/sf0.001", str(tmp_path / "out"), val_ratio=0.2)
    assert run(spark, c, dry_run=True)["rows"] == {}
    m = run(spark, c)
    assert m["rows"]["items"] > m["rows"]["audit"] == m["rows"]["split"] > 0
    out = spark.read.parquet(str(tmp_path / "out" / "split"))
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "val"}
    with pytest.raises(Exception):
        run(spark, c)


def test_audit_rules(spark):
    rows = [(1, "s", "c", "q", "a", 0.9, 2.0), (2, "s", "c", "q", "a", 0.1, -2.0), (3, "s", "c", "q", "a", None, None), (4, "s", "c", " ", "a", 0.9, 2.0)]
    df = spark.createDataFrame(rows, "pos long, section string, content string, question string, answer string, prob_yes double, log_odds double")
    keep = lambda c: sorted(r["pos"] for r in audit(df, c).collect())
    assert keep(Config("t", "o")) == [1, 3] == keep(Config("t", "o", scope="global")) == keep(Config("t", "o", strategy="threshold", threshold=0.0))
    assert keep(Config("t", "o", percent=0)) == [1, 2, 3]
    with pytest.raises(ValueError):
        audit(df.where("pos = 3"), Config("t", "o"))
