"""The rule scan: one projection that evaluates every rule over three views.

For each row and each rule applicable to the row's direction, the rule hits
when its pattern matches the raw text, the ``within`` view or the ``between``
view (§ functions.unicode).  The output is the list of hit rule ids in
engine order and the maximum score (0.0 when nothing hits).

Plan shape (all narrow, one stage):

    scan -> [repartition if the input has too few splits]
         -> Project(nfkc via ICU)          # JVM; Python only without ICU
         -> Project(views, probe texts)    # built-in expressions
         -> Project(hit flags)             # rlike per rule/view, short-circuit
         -> Project(rules_hit, det_score)

Work avoided per row, all exact:

* a normalised view equal to an earlier view is not scanned again;
* a rule whose pattern needs literals that the lower-cased view lacks skips its
  regex on that view (``operators.literals`` reads them off the pattern);
* the literal is looked for from its rarest character on, so that few places of a text are compared;
* texts of ASCII and Latin-1 letters are their own NFKC and folded form, and hold no white space beyond ASCII;
* the four Unicode rules only scan the raw view (both normalised views delete
  the characters they look for), of texts with other characters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonrpc import argv_text
from ..functions.unicode import INVISIBLE_CLASS, collapse_whitespace, fold_homoglyphs, is_plain, nfkc, probe_text, strip_invisible
from ..functions.memo import column_memo
from ..session import check_conf
from .literals import WIDE, Condition, rare_end
from .rules import BUILTIN_RULES, C2S, Rule, check_patterns

_VIEWS = ("_fs_raw", "_fs_within", "_fs_between")
_NEW = (None, "_fs_wnew", "_fs_bnew")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal rows to ``min_partitions`` partitions, or as many as
    ``spark.framescan.scan.minPartitions`` says; without either the input keeps its
    splits.  For a single machine reading files of few row groups; on a
    cluster size the splits with ``spark.sql.files.maxPartitionBytes``.  Runs
    no job: the plan is not looked at."""
    target = min_partitions or int(df.sparkSession.conf.get("spark.framescan.scan.minPartitions", "0"))
    return df.repartition(target) if target else df


def _occurs(condition: Condition, text: Column) -> Column:
    """The condition on literals, as one short-circuit expression over a lower-cased text."""
    if condition == WIDE:
        return ~F.col("_fs_plain")  # of the raw text: a plain text has no other view that is not plain
    if isinstance(condition, str):
        return text.contains(rare_end(condition))
    kind, *parts = condition
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [_occurs(p, text) for p in parts])


@column_memo
def _candidate(rule: Rule, text: str) -> Column:
    """Whether a text holds the literals that a match of the rule needs."""
    return _occurs(rule.condition, F.col(text)) if rule.condition is not None else F.lit(True)


@column_memo
def _view_hit(rule: Rule, n: int, raw_only: bool) -> Column:
    """Whether a rule, the ``n``-th, matches a view whose literals allow it."""
    pattern = rule.java_pattern
    hit = F.col(f"_fs_c{n}") & F.col(_VIEWS[0]).rlike(pattern)
    if not (raw_only or rule.raw_view_only):
        # both normalised views hold the same literals: they differ in white space only
        for view, new in zip(_VIEWS[1:], _NEW[1:]):
            hit = hit | (F.col(new) & F.col(f"_fs_d{n}") & F.col(view).rlike(pattern))
    return F.coalesce(hit, F.lit(False))


def _with_hits(df: DataFrame, rules: Sequence[Rule], direction: str | Column, raw_only: bool) -> tuple[DataFrame, list[str]]:
    """Hit flags of all rules.  The literals are looked for first, once for the raw text and once more
    where the normalised text is another one: that leaves each text its candidate rules."""
    applies = {n: direction.isin(*r.apply_to) if isinstance(direction, Column) else F.lit(True) for n, r in enumerate(rules)}
    df = df.select("*", *[(applies[n] & _candidate(r, "_fs_p0")).alias(f"_fs_c{n}") for n, r in enumerate(rules)])
    drop = [f"_fs_c{n}" for n in range(len(rules))] + ["_fs_p0"]
    if not raw_only:
        more = {n: r for n, r in enumerate(rules) if not r.raw_view_only}
        df = df.select(
            "*", *[F.when(F.col("_fs_wnew"), applies[n] & _candidate(r, "_fs_p1")).otherwise(F.col(f"_fs_c{n}")).alias(f"_fs_d{n}") for n, r in more.items()]
        )
        drop += [f"_fs_d{n}" for n in more] + ["_fs_p1"]
    flags = [f"_fs_h{n}" for n in range(len(rules))]
    return df.select("*", *[_view_hit(r, n, raw_only).alias(f) for n, (r, f) in enumerate(zip(rules, flags))]), flags + drop


def with_scan_text(df: DataFrame, text_col: str, direction: str | Column) -> DataFrame:
    """Text fed to the rules: for client->server rows the space-joined string
    arrays of a ``tools/call`` request's ``params.arguments`` are appended."""
    text = F.col(text_col)
    if isinstance(direction, str) and direction != C2S:
        return df.withColumn("_fs_raw", text)
    extra = argv_text(text)
    appended = F.when(extra != "", F.concat(text, F.lit(" "), extra)).otherwise(text)
    if isinstance(direction, Column):
        appended = F.when(direction == C2S, appended).otherwise(text)
    return df.withColumn("_fs_raw", appended)


def rule_scan(
    df: DataFrame,
    text_col: str,
    direction: str | Column,
    rules: Sequence[Rule] | None = None,
    *,
    hits_col: str = "rules_hit",
    score_col: str = "det_score",
    keep_views: bool = False,
    raw_only: bool = False,
) -> DataFrame:
    """Append ``rules_hit`` (comma-joined ids in engine order, NULL when none)
    and ``det_score`` (max score of hit rules, 0.0 when none).

    ``direction`` is a literal direction or a Column holding one per row.
    ``raw_only`` scans the raw text alone (rule linting semantics).
    """
    rules = list(rules or BUILTIN_RULES)
    check_conf(df.sparkSession)
    check_patterns(rules)
    if isinstance(direction, str):
        rules = [r for r in rules if direction in r.apply_to]
    df = with_scan_text(df, text_col, direction)
    raw = F.col("_fs_raw")
    df = df.withColumn("_fs_plain", is_plain(raw))
    plain = F.col("_fs_plain")
    if raw_only:
        df = df.withColumn("_fs_p0", probe_text(raw, plain))
        df, drop = _with_hits(df, rules, direction, True)
        return _finish(df, rules, drop[: len(rules)], hits_col, score_col, [*drop, "_fs_raw", "_fs_plain"])
    # fold(nfkc(raw)) once, of texts that it can change; the invisible-character pass only where there are any
    df = df.withColumn("_fs_f", F.when(plain, raw).otherwise(fold_homoglyphs(nfkc(raw))))
    df = df.withColumn("_fs_inv", ~plain & F.col("_fs_f").rlike(INVISIBLE_CLASS))
    f, inv = F.col("_fs_f"), F.col("_fs_inv")
    df = df.select(
        *[c for c in df.columns if c not in ("_fs_f", "_fs_inv")],
        F.when(inv, strip_invisible(f, "")).otherwise(f).alias("_fs_within"),
        collapse_whitespace(F.when(inv, strip_invisible(f, " ")).otherwise(f), plain).alias("_fs_between"),
    )
    df = df.withColumns({
        "_fs_wnew": F.col("_fs_within") != raw,
        "_fs_bnew": (F.col("_fs_between") != raw) & (F.col("_fs_between") != F.col("_fs_within")),
        "_fs_p0": probe_text(raw, plain),
    })
    # Every whitespace-free substring of ``between`` is also one of ``within``
    # (between only turns invisibles into spaces and shortens whitespace runs),
    # so the literals of ``within`` serve both; where within equals raw, raw's do.
    df = df.withColumn("_fs_p1", F.when(F.col("_fs_wnew"), probe_text(F.col("_fs_within"))))
    df, drop = _with_hits(df, rules, direction, False)
    flags = drop[: len(rules)]
    drop += ["_fs_wnew", "_fs_bnew", "_fs_plain"]
    if not keep_views:
        drop += list(_VIEWS)
    return _finish(df, rules, flags, hits_col, score_col, drop)


def _finish(df: DataFrame, rules, flags, hits_col, score_col, drop) -> DataFrame:
    hits = F.concat_ws(",", *[F.when(F.col(f), F.lit(r.id)) for r, f in zip(rules, flags)])
    score = F.greatest(F.lit(0.0), *[F.when(F.col(f), F.lit(float(r.score))) for r, f in zip(rules, flags)]) if rules else F.lit(0.0)
    keep = [c for c in df.columns if c not in set(drop) | {hits_col, score_col}]
    return df.select(*keep, F.when(hits != "", hits).alias(hits_col), score.alias(score_col))


def hits_array(col: Column) -> Column:
    """ARRAY<STRING> form of ``rules_hit`` (NULL stays NULL, like the audit log)."""
    return F.when(col.isNotNull(), F.split(col, ","))


def rule_hits_long(scanned: DataFrame, key_cols: Sequence[str], rules_df: DataFrame | None = None,
                   hits_col: str = "rules_hit") -> DataFrame:
    """One row per (key, hit rule), with the rule's position in the hit list.

    ``explode_outer`` + a later filter keeps the optimiser from pushing a
    ``size(hits) > 0`` predicate below the scan projection (which would run
    every regex twice)."""
    exploded = scanned.select(
        *key_cols, F.posexplode_outer(F.split(F.col(hits_col), ",")).alias("hit_pos", "rule_id")
    ).where(F.col("rule_id").isNotNull())
    if rules_df is not None:
        exploded = exploded.join(rules_df, "rule_id", "left")
    return exploded
