"""Turning rows into prompts, turns, grids and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import stable_u32, text_or_empty, ustrip


def chat(system: Column | None, user: Column) -> Column:
    """Messages of a prompt, with or without a system turn."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", user)) if system is None else F.array(turn("system", system), turn("user", user))


def turns_to_text(messages: Column) -> Column:
    """``role: text`` lines of the turns that are not blank."""
    filled = F.filter(messages, lambda m: text_or_empty(m["content"]) != "")
    return F.array_join(F.transform(filled, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), ustrip(m["content"]))), "\n")


def render_chat(messages: Column) -> Column:
    """Turns between markers, ready for an answer."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), ustrip(m["content"]), F.lit("\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|assistant|>\n"))


def numbered_block(texts: Column) -> Column:
    """Numbered examples with a blank line between them."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), t)), "\n\n")


def spec_grid(domains: DataFrame, sections: list[str], per_section: int, seed: int) -> DataFrame:
    """Every domain with every section and item index, and the derived seed of each. The sections
    are a configured list; the grid grows with the domains alone."""
    spread = domains.select("*", F.posexplode(F.array(*[F.lit(s) for s in sections])).alias("s", "section"))
    spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_section - 1))))
    return spread.withColumn("seed", F.lit(seed) + F.col("domain_no") * 1000003 + F.col("s") * 1009 + F.col("i") * 17)


def unpivot_swap(df: DataFrame, first: str, second: str, mode: str = "both") -> DataFrame:
    """A row for each candidate as the first one, ``source_candidate`` 1 or 2, the other behind it;
    rows whose first candidate is blank are left out."""
    a, b = F.col(first), F.col(second)
    one = F.struct(F.lit(1).alias("source_candidate"), a.alias("candidate"), b.alias("other"))
    two = F.struct(F.lit(2).alias("source_candidate"), b.alias("candidate"), a.alias("other"))
    chosen = {"candidate1": [one], "candidate2": [two], "both": [one, two]}[mode]
    return df.withColumn("_x", F.explode(F.array(*chosen))).select("*", "_x.*").drop("_x").where(text_or_empty(F.col("candidate")) != "")


def label_mask(ids: Column, prompt: Column, most: int) -> Column:
    """Labels of a training example: ids with the prompt's part as -100; ids and prompt are both cut
    to ``most``. Null if nothing is left to learn, as where the prompt alone takes all of them."""
    cut = F.slice(ids, 1, most)
    n, asked = F.size(cut), F.least(prompt, F.lit(most))
    k = F.greatest(F.least(asked, n - 1), F.lit(0))
    return F.when(n > asked, F.concat(F.array_repeat(F.lit(-100), k), F.slice(cut, k + 1, F.greatest(n - k, F.lit(0)))))


def trainable(messages: Column) -> Column:
    """Whether a chat can be trained on: two turns or more, the last one the assistant's."""
    return F.coalesce((F.size(messages) >= 2) & (F.element_at(messages, -1)["role"] == "assistant"), F.lit(False))


def collate(df: DataFrame, place: str, size: int, pad: int) -> DataFrame:
    """``df`` (input_ids, labels, further columns) with ``batch``, its ``size`` rows by 0-based
    ``place``, ids and labels padded to the longest of the batch, and ``attention_mask``."""
    placed = df.withColumn("batch", F.floor(F.col(place) / size))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))  # a batch has at most ``size`` rows
    n = F.size("input_ids")
    fill = lambda x, k: F.array_repeat(F.lit(x), k)
    room = F.col("_longest") - n
    return (
        placed.withColumn("_longest", longest)
        .withColumn("attention_mask", F.concat(fill(1, n), fill(0, room)))
        .withColumn("labels", F.concat("labels", fill(-100, room)))
        .withColumn("input_ids", F.concat("input_ids", fill(pad, room)))
        .drop("_longest")
    )


def rl_rows(df: DataFrame, source: str, user: Column, systems: list[str], key: str, seed: int | None) -> DataFrame:
    """Rows for reinforcement learning with the columns of ``df``: ``data_source``, ``prompt``,
    ``reward_model`` and ``extra_info``. ``user`` is the builder of the user turn, over the columns of
    ``df`` (content, question, answer, section). With a seed each row draws its system prompt, without
    one all have the first."""
    drawn = F.lit(systems[0]) if seed is None else F.get(F.array(*[F.lit(x) for x in systems]), (stable_u32(seed, F.col(key)) % len(systems)).cast("int"))
    known = {c: F.coalesce(c, F.lit("")) for c in ("content", "question", "answer")}
    extra = F.struct(known["content"].alias("content"), known["question"].alias("question"), known["answer"].alias("reference"), F.coalesce("section", F.lit("unknown")).alias("section"))
    return df.select(
        key, F.lit(source).alias("data_source"), chat(drawn, user).alias("prompt"),
        F.struct(F.lit("model").alias("style"), known["answer"].alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"),
    )


def annotate(rows: DataFrame, task_type: str, explanations: DataFrame | None = None) -> DataFrame:
    """``rows`` with task and conversation type in ``extra_info`` and, where ``explanations`` (content,
    question, explanation) is given, the explanation of the same content and question, or an empty one."""
    e = F.col("extra_info").withField("task_type", F.lit(task_type)).withField("conv_type", F.lit(task_type))
    if explanations is None:
        return rows.withColumn("extra_info", e)
    x = explanations.select(F.col("content").alias("_c"), F.col("question").alias("_q"), F.col("explanation").alias("_e"))
    joined = rows.join(x, (F.col("extra_info.content") == F.col("_c")) & (F.col("extra_info.question") == F.col("_q")), "left")
    return joined.withColumn("extra_info", e.withField("sft_explanation", F.coalesce("_e", F.lit("")))).drop("_c", "_q", "_e")


def render_inst(messages: Column) -> Column:
    """Turns between instruction brackets, the system turns in the first of them; turns that answer
    no user turn are left out, and system turns alone count as a user turn."""
    clean = F.transform(messages, lambda m: F.struct(F.lower(text_or_empty(m["role"])).alias("role"), text_or_empty(m["content"]).alias("content")))
    said = F.transform(F.filter(clean, lambda m: m["role"] == "system"), lambda m: m["content"])
    system = ustrip(F.array_join(F.filter(said, lambda x: x != ""), "\n\n"))
    turns = F.filter(clean, lambda m: m["role"] != "system")
    alone = F.array(F.struct(F.lit("user").alias("role"), ustrip(F.array_join(said, "\n\n")).alias("content")))
    asked = F.when(F.size(turns) == 0, alone).otherwise(turns)
    head = F.when((F.size(turns) > 0) & (system != ""), F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
    state = F.struct(F.lit("").alias("out"), F.lit(True).alias("first"), F.lit("").alias("before"))

    def step(s: Column, m: Column) -> Column:
        user, answer = m["role"] == "user", (m["role"] == "assistant") & (s["before"] == "user")
        chunk = (
            F.when(user, F.concat(F.lit("<s>[INST] "), F.when(s["first"], head).otherwise(""), m["content"], F.lit(" [/INST]")))
            .when(answer, F.concat(F.lit(" "), m["content"], F.lit(" </s>")))
            .otherwise("")
        )
        return F.struct(F.concat(s["out"], chunk).alias("out"), (s["first"] & ~user).alias("first"), m["role"].alias("before"))

    return F.aggregate(asked, state, step)["out"]


def continuations(df: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Every row once for each continuation: ``class`` and ``continuation``, ready to be scored; the
    variants are a configured list."""
    all_ = [F.struct(F.lit(k).alias("class"), F.lit(x).alias("continuation")) for k, xs in variants.items() for x in xs]
    return df.select("*", F.explode(F.array(*all_)).alias("_v")).select("*", "_v.class", "_v.continuation").drop("_v")


def class_mass(scored: DataFrame, key: str, classes: list[str], logprob: str = "logprob") -> DataFrame:
    """(key, one column a class): probability that the continuations of a class have together;
    those without a finite log-probability are skipped."""
    lp = F.col(logprob)
    ok = lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) < float("inf"))
    mass = [F.sum(F.when(ok & (F.col("class") == c), F.exp(lp)).otherwise(0.0)).alias(c) for c in classes]
    return scored.groupBy(key).agg(*mass)
