"""DuckDB spelling of the rule scan, used only by the SQL oracle.

Same three views, same rule order, same patterns (RE2 flags), same argv
append for client->server ``tools/call`` requests (via ``json_tree``).  No
probes here: the oracle evaluates every regex, so it also checks that the
Spark-side probes never hide a hit.
"""

from __future__ import annotations

from ..functions import unicode as U
from ..operators import rules as R


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_argv(t: str) -> str:
    """Space-joined string arrays under ``params.arguments`` of a tools/call
    request (pre-order), '' otherwise."""
    v = f"(CASE WHEN json_valid({t}) THEN {t} END)"
    args = f"json_extract({v}, '$.params.arguments')"
    ok = (
        f"(json_type({v}) = 'OBJECT' AND json_type({v}, '$.method') = 'VARCHAR' "
        f"AND json_extract_string({v}, '$.method') = 'tools/call' AND json_type({v}, '$.params') = 'OBJECT' "
        f"AND coalesce(json_type({args}), 'NULL') <> 'NULL')"
    )
    safe = f"coalesce(CASE WHEN {ok} THEN {args} END, '{{}}'::JSON)"
    tree = f"json_tree({safe})"
    chunks = f"""(SELECT string_agg(chunk, ' ' ORDER BY aid) FROM (
        SELECT a.id AS aid, string_agg(json_extract_string(c.value, '$'), ' ' ORDER BY c.id) AS chunk
        FROM {tree} a JOIN {tree} c ON c.parent = a.id
        WHERE a.type = 'ARRAY' AND c.type = 'VARCHAR' GROUP BY a.id))"""
    return f"CAST(coalesce(CASE WHEN {ok} THEN {chunks} END, '') AS VARCHAR)"


def _hit(rule: R.Rule, direction: str, raw_only: bool = False) -> str:
    p = _q(rule.re2_pattern)
    views = ["_r"] if (rule.raw_view_only or raw_only) else ["_r", "_w", "_b"]
    cond = " OR ".join(f"regexp_matches({v}, {p})" for v in views)
    if direction in R.DIRECTIONS:
        return f"({cond})"
    dirs = ", ".join(_q(d) for d in rule.apply_to)
    return f"({direction} IN ({dirs}) AND ({cond}))"


def sql_scan(source: str, keep: list[str], text: str, direction: str, rules=None, raw_only: bool = False) -> str:
    """``SELECT keep..., rules_hit, det_score`` over ``source``.

    ``direction`` is a direction literal value or a column name."""
    rules = list(rules or R.BUILTIN_RULES)
    appended = f"(CASE WHEN _x <> '' THEN {text} || ' ' || _x ELSE {text} END)"
    if direction in R.DIRECTIONS:
        rules = [r for r in rules if direction in r.apply_to]
        scan_text = appended if direction == R.C2S else text
        extra = sql_argv(text) if direction == R.C2S else "''"
    else:
        scan_text = f"(CASE WHEN {direction} = {_q(R.C2S)} THEN {appended} ELSE {text} END)"
        extra = f"(CASE WHEN {direction} = {_q(R.C2S)} THEN {sql_argv(text)} ELSE '' END)"
    hits = [f"CASE WHEN {_hit(r, direction, raw_only)} THEN {_q(r.id)} END" for r in rules]
    scores = [f"CASE WHEN {_hit(r, direction, raw_only)} THEN {r.score} END" for r in rules]
    hits_expr = f"nullif(concat_ws(',', {', '.join(hits)}), '')" if hits else "NULL"
    score_expr = f"CAST(greatest(0.0, {', '.join(scores)}) AS DOUBLE)" if scores else "0.0::DOUBLE"
    keep_sql = ", ".join(keep)
    return f"""(SELECT {keep_sql}, {hits_expr} AS rules_hit, {score_expr} AS det_score FROM (
      SELECT *, {U.sql_within('_r')} AS _w, {U.sql_between('_r')} AS _b FROM (
        SELECT *, {scan_text} AS _r FROM (SELECT *, {extra} AS _x FROM {source}))))"""
