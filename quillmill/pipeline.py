"""Stages of a curation run as one lazy plan: items, audit, split, each written where configured."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.scores import HIGHER_IS_BETTER, LOWER_IS_BETTER, score_field
from quillmill.functions.text import first_filled
from quillmill.operators.filters import drop_bottom, drop_bottom_per_group, has_fields, passes_threshold
from quillmill.operators.splits import group_split
from quillmill.session import materialize
from quillmill.sources import writers

STAGES = ("items", "audit", "split")


@dataclass(frozen=True)
class Config:
    """Settings of a run; anything unknown or out of range is refused before the first stage."""

    tables: str
    output: str
    stages: dict[str, bool] = field(default_factory=dict)
    score: str = "drop_minus_keep"
    strategy: str = "drop_bottom"
    scope: str = "section"
    percent: float = 50.0
    threshold: float = 0.0
    val_ratio: float = 0.02
    seed: int = 0
    overwrite: bool = False

    def __post_init__(self) -> None:
        unknown = set(self.stages) - set(STAGES)
        if unknown:
            raise ValueError(f"no such stages: {', '.join(sorted(unknown))}")
        if self.score not in HIGHER_IS_BETTER + LOWER_IS_BETTER:
            raise ValueError(f"no such score: {self.score}")
        if self.strategy not in ("drop_bottom", "threshold") or self.scope not in ("section", "global"):
            raise ValueError("strategy is drop_bottom or threshold, scope section or global")
        if not 0 <= self.percent <= 100 or not 0 <= self.val_ratio <= 1:
            raise ValueError("percent lies within 0..100, val_ratio within 0..1")


def chosen_stages(config: Config, only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """Stages to run, in order: the enabled ones, or ``only`` these, without ``skip``."""
    unknown = set(only or []) | set(skip or [])
    if unknown - set(STAGES):
        raise ValueError(f"no such stages: {', '.join(sorted(unknown - set(STAGES)))}")
    names = only if only else [s for s in STAGES if config.stages.get(s, True)]
    return [s for s in STAGES if s in names and s not in (skip or [])]


def audit(items: DataFrame, config: Config) -> DataFrame:
    """Items that stay: parts filled, not among the worst by the chosen rule. Unscored items stay
    under every rule; a ranked drop over no scored item at all is refused."""
    scored = items.withColumn("score", score_field(config.score, F.col("prob_yes"), F.col("log_odds"))).where(has_fields("section", "content", "question", "answer"))
    if config.strategy == "threshold":
        return scored.where(passes_threshold(F.col("score"), config.threshold, config.score))
    known = materialize(scored.where("score is not null"), "scored")
    if config.percent > 0 and known.isEmpty():
        raise ValueError("no item has a score: a ranked drop would be arbitrary")
    kept = drop_bottom(known, config.percent, config.score) if config.scope == "global" else drop_bottom_per_group(known, config.percent, config.score, "section")
    return kept.select(*scored.columns).unionByName(scored.where("score is null"))


def run(spark: SparkSession, config: Config, only: list[str] | None = None, skip: list[str] | None = None, dry_run: bool = False) -> dict[str, Any]:
    """Run the chosen stages; each reads what the stage before it wrote. The manifest says what
    ran, from where to where, and how many rows there were."""
    from quillmill.plans import views

    names = chosen_stages(config, only, skip)
    manifest: dict[str, Any] = {"stages": names, "tables": config.tables, "output": config.output, "rows": {}}
    if dry_run:
        return manifest
    for s in names:
        path = f"{config.output}/{s}"
        if s == "items":
            df = views.qa(spark, config.tables)
        elif s == "audit":
            df = audit(spark.read.parquet(f"{config.output}/items"), config)
        else:
            domains = views.tasks(spark, config.tables).select("task_no", "domain_index", "domain_seed")
            key = F.coalesce(F.col("domain_index").cast("string"), first_filled(F.col("domain_seed")), F.concat(F.lit("record::"), F.col("pos").cast("string")))
            kept = spark.read.parquet(f"{config.output}/audit").join(domains, "task_no", "left")
            df = group_split(kept, key, "pos", config.val_ratio, config.seed)
        writers.write_parquet(df, path, config.overwrite, ["split"] if s == "split" else None)
        manifest["rows"][s] = spark.read.parquet(path).count()
    writers.write_manifest(spark, manifest, f"{config.output}/manifest")
    return manifest
