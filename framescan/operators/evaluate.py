"""Labelled-corpus evaluation: detection rate per attack class, the overall
pass/fail gate, and per-rule example quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import DIRECTIONS

EXPECTED = ("catch", "evade")


def valid_attacks(df: DataFrame) -> DataFrame:
    """Keep rows whose enums are valid and whose text is non-empty."""
    ok = (
        F.col("direction").isin(*DIRECTIONS)
        & F.col("expected").isin(*EXPECTED)
        & (F.length(F.trim(F.col("class_id"))) > 0)
        & (F.length(F.trim(F.col("attack_id"))) > 0)
        & (F.length(F.trim(F.col("text"))) > 0)
    )
    return df.where(F.coalesce(ok, F.lit(False)))


def attack_eval(scanned: DataFrame, hit: Column | None = None) -> DataFrame:
    """Per class: count, caught, evaded, detect %, status.

    ``catch`` classes must let nothing evade; ``evade`` classes must catch
    nothing (a documented gap that starts matching is reported too)."""
    hit = hit if hit is not None else F.col("rules_hit").isNotNull()
    per = scanned.groupBy("class_id").agg(
        F.count("*").alias("n_attacks"),
        F.count_if(hit).alias("caught"),
        F.count_if(~hit).alias("evaded"),
        F.first("expected").alias("expected"),
        F.first("direction").alias("direction"),
    )
    return per.select(
        "class_id",
        "direction",
        "expected",
        "n_attacks",
        "caught",
        "evaded",
        F.round(F.col("caught").cast("double") * 100.0 / F.col("n_attacks"), 2).alias("detect_pct"),
        F.when(
            ((F.col("expected") == "catch") & (F.col("evaded") == 0)) | ((F.col("expected") == "evade") & (F.col("caught") == 0)),
            "OK",
        ).otherwise("MISMATCH").alias("status"),
    )


def attack_eval_overall(per_class: DataFrame) -> DataFrame:
    """One row: totals, overall %, PASS iff every class is OK, and the
    catch classes that let something through (sorted, comma-joined)."""
    return per_class.agg(
        F.count("*").alias("n_classes"),
        F.sum("n_attacks").alias("n_attacks"),
        F.sum("caught").alias("caught"),
        F.round(F.sum("caught").cast("double") * 100.0 / F.sum("n_attacks"), 2).alias("overall_pct"),
        F.when(F.bool_and(F.col("status") == "OK"), "PASS").otherwise("FAIL").alias("status"),
        F.array_join(
            F.array_sort(F.collect_list(F.when((F.col("expected") == "catch") & (F.col("evaded") > 0), F.col("class_id")))), ","
        ).alias("failing_catch_classes"),
    )


def rule_examples(examples: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per rule, how its own examples fare against its pattern on the text as
    it stands, in any direction: ``rule_id, attack_examples, attack_missed,
    benign_examples, benign_matched, status``.

    ``examples``: ``rule_id, attack, text`` (``rules.examples_df``, or a table
    of any size); ``patterns``: ``rule_id, java_pattern``.  ``drifted``: some
    example no longer does what it is there for; ``no_examples``: no attack
    example at all; else ``ok``.  Examples of unknown rules and NULL texts count for nothing."""
    hit = F.regexp_like("text", "java_pattern")
    judged = examples.where(F.col("text").isNotNull() & F.col("attack").isNotNull()).join(patterns, "rule_id").groupBy("rule_id").agg(
        F.count_if("attack").alias("attack_examples"),
        F.count_if(F.col("attack") & ~hit).alias("attack_missed"),
        F.count_if(~F.col("attack")).alias("benign_examples"),
        F.count_if(~F.col("attack") & hit).alias("benign_matched"),
    )
    counts = ("attack_examples", "attack_missed", "benign_examples", "benign_matched")
    out = patterns.select("rule_id").join(judged, "rule_id", "left").select("rule_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
    drifted = (F.col("attack_missed") > 0) | (F.col("benign_matched") > 0)
    return out.withColumn("status", F.when(drifted, "drifted").when(F.col("attack_examples") == 0, "no_examples").otherwise("ok"))


def rule_quality(scanned_raw: DataFrame, targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: attack examples written for it that its pattern misses on the
    raw text, and unplanted (benign) texts its pattern matches.

    ``scanned_raw``: ``item_id, attack_id (NULL = benign), rules_hit`` from a
    raw-view-only scan; ``targets``: ``attack_id, target_rule``; ``rules``:
    ``rule_id``.  The optimiser broadcasts them where their size allows; the
    scanned corpus is only aggregated."""
    hits_long = scanned_raw.select(
        "item_id", "attack_id", F.explode_outer(F.split(F.col("rules_hit"), ",")).alias("rule_id")
    ).where(F.col("rule_id").isNotNull())
    benign_hits = hits_long.where(F.col("attack_id").isNull()).groupBy("rule_id").agg(F.count("*").alias("benign_matched"))
    # scalar subquery: one number, evaluated once by Spark
    n_benign = scanned_raw.where(F.col("attack_id").isNull()).agg(F.count("*")).scalar()
    attacks = scanned_raw.where(F.col("attack_id").isNotNull()).join(targets, "attack_id")
    attack_stats = attacks.groupBy(F.col("target_rule").alias("rule_id")).agg(
        F.count("*").alias("attack_examples"),
        F.count_if(~F.coalesce(F.array_contains(F.split(F.col("rules_hit"), ","), F.col("target_rule")), F.lit(False))).alias("attack_missed"),
    )
    out = (
        rules.select("rule_id")
        .join(attack_stats, "rule_id", "left")
        .join(benign_hits, "rule_id", "left")
        .withColumn("benign_examples", n_benign)
    )
    return out.select(
        "rule_id",
        F.coalesce("attack_examples", F.lit(0)).cast("long").alias("attack_examples"),
        F.coalesce("attack_missed", F.lit(0)).cast("long").alias("attack_missed"),
        F.col("benign_examples").cast("long").alias("benign_examples"),
        F.coalesce("benign_matched", F.lit(0)).cast("long").alias("benign_matched"),
    )
