"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are counted per cell of (source, language, topic). Raking scales the cell weights until their sums by source, by
language and by topic meet the three target marginals; a document is then kept with the probability its cell needs,
``rate * target weight / weight there``, where ``rate`` is the largest that leaves every probability at 1 or below. The
draw of a document is a fixed number from its id, so any rerun keeps the same documents.

Only the table of cells goes through the raking, as window sums; it is stored every few rounds to keep plans short.
Rounds end when no marginal share is further than ``TOLERANCE`` from its target, or after ``MOST_ROUNDS`` where targets
conflict (an empty cell can make them so); the residual that is left is returned in ``mix_residual``.
Nothing is collected to the driver. A hot source is only a sum.

Defined cases: a missing source, language or text counts as the group ``(none)`` or as no tokens; documents without
tokens keep the probability of their cell; a cell whose targets are zero is not kept; targets that name an absent group
are ignored and the rest scaled to 1; repeated ids draw alike; an empty table gives an empty one; extra columns stay, but for those named ``mix_...``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import forget, stored, unit

NONE = "(none)"
STEP, TOLERANCE, MOST_ROUNDS = 4, 1e-9, 120  # rounds between two looks at the residual; the residual that ends them; rounds of targets that conflict
SQL_ROUNDS = 32  # of the counterpart in SQL, which can't look at the residual
DIMS = ("source", "lang", "topic")
#: Topic and its pattern, in order of precedence; other texts are prose.
TOPICS = (("licence", r"(?i)licen[sc]ed? under|all rights reserved|copyright \("), ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[a-z]|\(\d{3}\) \d{3}-\d{4}"), ("shouted", r"!![ \n]|[A-Z]{5}"))


def n_tokens(text: Column) -> Column:
    """Words between spaces, as a count of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def with_cells(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None) -> DataFrame:
    """docs and mix_source, mix_lang, mix_topic, mix_tokens. topic: the topic of a row; by default rules on the text."""
    t = F.col(f"`{text}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_source", "mix_lang", "mix_topic", "mix_tokens")]
    return docs.select(
        *others, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)).alias("mix_source"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)).alias("mix_lang"),
        (topic_of(t) if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))).alias("mix_topic"), n_tokens(t).alias("mix_tokens"),
    )


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: Mapping[str, float] | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """cells (mix_source, mix_lang, mix_topic, tokens) and weight: the raked share, keep_prob: its probability, and
    residual: the largest distance of a marginal share from its target (one number).

    targets: by dimension, the wanted share of each group. A dimension without targets takes its own shares to the power
    ``temper`` (1 leaves them as they are).
    """
    targets, temper = targets or {}, temper or {}
    table = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMS:
        if d not in targets:
            goal = F.pow(F.sum("weight").over(Window.partitionBy(f"mix_{d}")), F.lit(float(temper.get(d, 1.0))))
        elif targets[d]:
            goal = F.coalesce(F.create_map(*[F.lit(x) for pair in targets[d].items() for x in pair])[F.col(f"mix_{d}")].cast("double"), F.lit(0.0))
        else:
            goal = F.lit(0.0)
        table = table.withColumn(f"goal_{d}", goal)
    old = table = stored(table, "cells")
    for d in DIMS:
        whole = table.select(f"mix_{d}", f"goal_{d}").distinct().agg(F.sum(f"goal_{d}")).first()[0]
        table = table.withColumn(f"goal_{d}", F.col(f"goal_{d}") / F.lit(float(whole or 1.0)))
    residual, r = float("inf"), 0
    while residual > TOLERANCE and r < most_rounds:
        for _ in range(STEP):
            for d in DIMS:
                there = F.sum("weight").over(Window.partitionBy(f"mix_{d}"))
                table = table.withColumn("weight", F.when(there > 0, F.col("weight") * F.col(f"goal_{d}") / there).otherwise(F.lit(0.0)))
        table, r = stored(table, "cells"), r + STEP
        forget(old)
        old = table
        gaps = [table.groupBy(f"mix_{d}").agg(F.abs(F.sum("weight") - F.max(f"goal_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in DIMS]
        residual = max(float(g.first()[0] or 0.0) for g in gaps)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    top = float(table.agg(F.max(ratio)).first()[0] or 0.0)
    prob = F.coalesce(ratio, F.lit(top)) / F.lit(top) if top else F.lit(0.0)
    return table.select("mix_source", "mix_lang", "mix_topic", "tokens", "weight", prob.alias("keep_prob"), F.lit(residual).alias("residual"))


def mix(docs: DataFrame, doc_id: str = "doc_id", targets: Mapping[str, Mapping[str, float]] | None = None, temper: Mapping[str, float] | None = None, topic: Column | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """docs (or only the columns ``carry``) and mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_prob, mix_residual, mix_kept.

    Each text is read once: the marked documents are stored, the cells are counted and the documents drawn from those.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if not c.startswith("mix_")]
    marked = stored(with_cells(docs, topic=topic).select(*[F.col(f"`{c}`") for c in columns], "mix_source", "mix_lang", "mix_topic", "mix_tokens"), "marked")
    cells = marked.groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"))
    raked = rake(cells, targets, temper)
    raked = raked.select("mix_source", "mix_lang", "mix_topic", F.col("weight").alias("mix_weight"), F.col("keep_prob").alias("mix_prob"), F.col("residual").alias("mix_residual"))
    out = marked.join(raked, ["mix_source", "mix_lang", "mix_topic"])
    return out.withColumn("mix_kept", unit(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) < F.col("mix_prob"))


def oracle_sql(temper: Mapping[str, float], rounds: int = SQL_ROUNDS) -> str:
    """The same raking as a chain of window sums for DuckDB."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    tokens = r"coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)"
    parts = [
        f"marked AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic, CAST({tokens} AS BIGINT) AS tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM marked GROUP BY ALL)",
        "goals AS (SELECT *, CAST(tokens AS DOUBLE) AS weight, " + ", ".join(f"pow(sum(CAST(tokens AS DOUBLE)) OVER (PARTITION BY {d}), {float(temper.get(d, 1.0))}) AS goal_{d}" for d in DIMS) + " FROM cells)",
        "r0 AS (SELECT source, lang, topic, tokens, weight, " + ", ".join(f"goal_{d} / (SELECT sum(g) FROM (SELECT DISTINCT {d}, goal_{d} AS g FROM goals)) AS goal_{d}" for d in DIMS) + " FROM goals)",
    ]
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            parts.append(f"r{k + 1} AS (SELECT * EXCLUDE (weight), CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0.0 END AS weight FROM r{k})")
            k += 1
    parts.append(f"top AS (SELECT max(weight / tokens) AS top FROM r{k} WHERE tokens > 0)")
    parts.append(f"probs AS (SELECT source, lang, topic, weight, coalesce(CASE WHEN tokens > 0 THEN weight / tokens END, top) / top AS prob FROM r{k}, top)")
    draw = "CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source AS mix_source, lang AS mix_lang, topic AS mix_topic, tokens AS mix_tokens, round(weight, 6) AS mix_weight, round(prob, 6) AS mix_prob, {draw} < prob AS mix_kept FROM marked JOIN probs USING (source, lang, topic)"
