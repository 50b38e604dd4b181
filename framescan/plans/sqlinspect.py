"""DuckDB spelling of the inspection pipeline (oracle only), classifier off."""

from __future__ import annotations

from ..operators import replies as RP
from ..operators.policy import DEFAULT_POLICY, Policy, sql_decide
from ..operators.rules import C2S, S2C
from ..sources import plant as P
from . import sqlframes as SF
from .sqlscan import sql_scan

ALLOWED_TOOLS = (f"{P.SERVER_NAME}.exec", f"{P.SERVER_NAME}.read_file")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_members(allowed=ALLOWED_TOOLS, policy: Policy = DEFAULT_POLICY) -> str:
    """Per-member inspection, mirroring ``operators.inspect.inspect_members``."""
    parsed = SF.sql_parsed_frames()
    tool = (
        f"CASE WHEN kind = 'request' AND method = 'tools/call' AND json_type(_v, '$.params') = 'OBJECT' "
        f"AND json_type(_v, '$.params.name') = 'VARCHAR' AND json_extract_string(_v, '$.params.name') <> '' "
        f"THEN '{P.SERVER_NAME}.' || json_extract_string(_v, '$.params.name') END"
    )
    allow = ", ".join(_q(t) for t in allowed)
    cap = f"coalesce(direction = '{C2S}' AND tool IS NOT NULL AND tool NOT IN ({allow}), false)" if allowed else "false"
    with_cap = f"(SELECT *, {cap} AS cap_blocked FROM (SELECT *, {tool} AS tool FROM {parsed}))"
    scanned = sql_scan(with_cap, ["* EXCLUDE (_x, _r, _w, _b)"], "member", "direction")
    d = sql_decide(
        policy,
        direction="direction",
        method="CASE WHEN kind IN ('request', 'notification') THEN method END",
        score="det_score",
        classifier="NULL::VARCHAR",
        rules_hit="rules_hit",
        raw="member",
    )
    id_json = "CASE WHEN json_type(_v, '$.id') IS NOT NULL THEN CAST(json_extract(_v, '$.id') AS VARCHAR) END"
    trace = RP.sql_trace("frame_id", "pos")
    reply = RP.sql_block_reply("direction", "kind", "id_json", "coalesce(_d.message, 'content judged unsafe')", trace)
    args = "coalesce(CASE WHEN coalesce(json_type(_v, '$.params.arguments'), 'NULL') <> 'NULL' THEN CAST(json_extract(_v, '$.params.arguments') AS VARCHAR) END, 'null')"
    cap_trace = RP.sql_trace("frame_id", "'cap'")
    return f"""(SELECT *,
          CASE WHEN _d.action = 'block' AND reply IS NULL THEN 'warn' ELSE _d.action END AS det_action,
          CASE WHEN (CASE WHEN _d.action = 'block' AND reply IS NULL THEN 'warn' ELSE _d.action END) = 'block' THEN 'BLOCK'
               WHEN (CASE WHEN _d.action = 'block' AND reply IS NULL THEN 'warn' ELSE _d.action END) = 'warn' THEN 'WARN' ELSE 'PASS' END AS det_verdict,
          _d.matched_rule AS matched_policy, _d.action AS policy_action, _d.message AS policy_message,
          CASE WHEN _d.action = 'block' AND reply IS NULL THEN 'downgraded:no_replacement'
               WHEN _d.action = 'block' THEN coalesce(classifier_note, 'trace=' || {trace}) ELSE classifier_note END AS note,
          (_d.action = 'block' AND reply IS NOT NULL) AS is_block,
          CASE WHEN cap_blocked THEN {RP.sql_capability_reply('id_json', 'tool')} END AS cap_reply,
          CASE WHEN cap_blocked THEN {args} END AS cap_args,
          CASE WHEN cap_blocked THEN 'blocked_by_capability tool=' || tool || ' trace=' || {cap_trace} END AS cap_note,
          {RP.sql_aborted_reply('kind', 'id_json')} AS aborted_reply
        FROM (SELECT *, CASE WHEN _d.action = 'block' THEN {reply} END AS reply FROM (
          SELECT *, {d} AS _d, {id_json} AS id_json, 'skipped:disabled' AS classifier_note, NULL::VARCHAR AS det_classifier
          FROM {scanned})))"""


def sql_outcomes(m: str = "m") -> str:
    det = "{'reply': reply, 'det_verdict': det_verdict, 'det_score': det_score, 'rules_hit': rules_hit, 'det_classifier': det_classifier, 'det_action': det_action, 'note': note}"
    return f"""(SELECT frame_id, direction, cap_blocked AS frame_cap, CASE WHEN is_block THEN pos END AS first_block,
          CASE WHEN is_block THEN {det} END AS blocking,
          CASE WHEN cap_blocked THEN cap_reply WHEN is_block THEN reply END AS reply_line
        FROM {m} WHERE n_members <= 1
      UNION ALL
      SELECT frame_id, direction, frame_cap, first_block, CASE WHEN first_block IS NOT NULL THEN blocking END,
          CASE WHEN frame_cap THEN '[' || coalesce(string_agg_c, '') || ']' WHEN first_block IS NOT NULL THEN '[' || coalesce(string_agg_d, '') || ']' END
      FROM (SELECT frame_id, first(direction) AS direction, bool_or(cap_blocked) AS frame_cap,
              min(CASE WHEN is_block THEN pos END) AS first_block,
              arg_min({det}, CASE WHEN is_block THEN pos END) AS blocking,
              string_agg(CASE WHEN cap_blocked THEN cap_reply ELSE aborted_reply END, ',' ORDER BY pos) AS string_agg_c,
              string_agg(CASE WHEN is_block THEN reply WHEN direction = '{S2C}' THEN member ELSE aborted_reply END, ',' ORDER BY pos) AS string_agg_d
            FROM {m} WHERE n_members > 1 GROUP BY frame_id))"""


def sql_audit(m: str = "m", o: str = "o") -> str:
    kind = SF.sql_event_kind("kind")
    fcap = f"(cap_blocked OR coalesce((SELECT true FROM {o} WHERE {o}.frame_id = x.frame_id AND {o}.frame_cap LIMIT 1), false))"
    members = f"""SELECT frame_id, pos, session_id, ts, direction, {kind} AS kind, msg_id, method,
          CASE WHEN cap_blocked THEN cap_args ELSE params_json END AS params_json,
          CASE WHEN cap_blocked THEN NULL ELSE result_json END AS result_json,
          CASE WHEN cap_blocked THEN NULL ELSE error_json END AS error_json,
          member AS raw,
          CASE WHEN cap_blocked THEN cap_note WHEN NOT _fcap THEN note END AS note,
          CASE WHEN cap_blocked THEN 'BLOCK' WHEN NOT _fcap THEN det_verdict END AS det_verdict,
          CASE WHEN NOT _fcap THEN det_score END AS det_score,
          CASE WHEN NOT _fcap THEN rules_hit END AS det_rules,
          CASE WHEN NOT _fcap THEN det_classifier END AS det_classifier,
          NULL::INTEGER AS det_latency_ms,
          CASE WHEN cap_blocked THEN 'block' WHEN NOT _fcap THEN det_action END AS det_action
        FROM (SELECT *, {fcap} AS _fcap FROM {m} x)"""
    syn_src = f"""(SELECT o.frame_id, s.session_id, s.ts, 'x' AS direction, o.blocking.reply AS member, o.blocking AS b
        FROM {o} o JOIN (SELECT frame_id, first(session_id) AS session_id, first(ts) AS ts FROM {m} GROUP BY frame_id) s USING (frame_id)
        WHERE o.direction = '{C2S}' AND NOT o.frame_cap AND o.first_block IS NOT NULL)"""
    syn = f"""SELECT frame_id, -1 AS pos, session_id, ts, '{S2C}' AS direction, {kind} AS kind, msg_id, method, params_json,
          result_json, error_json, member AS raw, 'synthetic-block' AS note, b.det_verdict, b.det_score, b.rules_hit AS det_rules,
          b.det_classifier, NULL::INTEGER AS det_latency_ms, b.det_action
        FROM {SF.sql_parse(syn_src)}"""
    return f"({members} UNION ALL {syn})"


def sql_inspect_with() -> str:
    """``WITH m AS (...), o AS (...), a AS (...)`` prefix."""
    return f"WITH m AS {sql_members()}, o AS {sql_outcomes('m')}, a AS {sql_audit('m', 'o')}"
