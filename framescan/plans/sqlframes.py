"""DuckDB spelling of the frame layer (oracle only): source cleanup, batch
split with Python-style ASCII re-escaping, the kind decision table and the
event columns."""

from __future__ import annotations

from ..functions.unicode import WS_CLASS
from ..sources import plant as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {_q('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def sql_ascii_escape(x: str) -> str:
    """Non-ASCII characters as lower-case ``\\uXXXX`` escapes (surrogate pairs
    above U+FFFF), like Python's ``json.dumps`` default."""
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c "
        f"WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) "
        f"ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), '')"
    )


def sql_frames_source(src: str) -> str:
    """CR/LF stripped, blank lines dropped."""
    line = "regexp_replace(raw, '[\\r\\n]+$', '')"
    return f"""(SELECT * REPLACE ({line} AS raw) FROM {src} WHERE {sql_strip(line)} <> '')"""


def sql_members(src: str) -> str:
    """``src`` columns + ``n_members, pos, member, is_batch``."""
    s = sql_strip("raw")
    is_arr = f"(json_valid({s}) AND json_type(CASE WHEN json_valid({s}) THEN {s} END) = 'ARRAY')"
    elems = f"json_extract(CASE WHEN {is_arr} THEN {s} END, '$[*]')"
    return f"""(SELECT * EXCLUDE (_m), len(_m) AS n_members, _p - 1 AS pos, _m[_p] AS member, len(_m) > 1 AS is_batch FROM (
        SELECT *, generate_subscripts(_m, 1) AS _p FROM (
          SELECT *, CASE WHEN {is_arr} THEN list_transform({elems}, lambda e: {sql_ascii_escape('CAST(e AS VARCHAR)')})
                         ELSE [raw] END AS _m FROM {src})))"""


def sql_parse(src: str) -> str:
    """``src`` (with ``member``) + ``kind, msg_id, method, params_json,
    result_json, error_json``."""
    s = "_s"
    v = "_v"

    def has(k):
        return f"coalesce(list_contains(json_keys({v}), '{k}'), false)"

    def ty(path):
        return f"json_type({v}, '{path}')"

    ints = "('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT')"
    rpc_ok = f"(NOT {has('jsonrpc')} OR ({ty('$.jsonrpc')} = 'VARCHAR' AND json_extract_string({v}, '$.jsonrpc') = '2.0'))"
    id_ok = f"({ty('$.id')} IN {ints[:-1]}, 'VARCHAR', 'NULL'))"
    method_ok = f"({ty('$.method')} = 'VARCHAR')"
    params_ok = f"(NOT {has('params')} OR {ty('$.params')} IN ('OBJECT', 'ARRAY', 'NULL'))"
    error_ok = (
        f"(NOT {has('error')} OR {ty('$.error')} = 'NULL' OR ({ty('$.error')} = 'OBJECT' "
        f"AND coalesce({ty('$.error.code')} IN {ints}, false) AND coalesce({ty('$.error.message')} = 'VARCHAR', false)))"
    )
    kind = f"""CASE WHEN {s} = '' THEN 'empty'
        WHEN {v} IS NULL THEN 'parse_error'
        WHEN json_type({v}) = 'ARRAY' THEN 'batch'
        WHEN json_type({v}) <> 'OBJECT' THEN 'parse_error'
        WHEN {has('method')} AND {has('id')} THEN CASE WHEN {rpc_ok} AND {id_ok} AND {method_ok} AND {params_ok} THEN 'request' ELSE 'parse_error' END
        WHEN {has('method')} THEN CASE WHEN {rpc_ok} AND {method_ok} AND {params_ok} THEN 'notification' ELSE 'parse_error' END
        WHEN {has('id')} AND ({has('result')} OR {has('error')}) THEN
          CASE WHEN {rpc_ok} AND {id_ok} AND {error_ok} THEN CASE WHEN {has('error')} THEN 'error' ELSE 'response' END ELSE 'parse_error' END
        ELSE 'parse_error' END"""

    def jtext(path):
        return f"CASE WHEN coalesce({ty(path)}, 'NULL') = 'NULL' THEN NULL ELSE CAST(json_extract({v}, '{path}') AS VARCHAR) END"

    data = jtext("$.error.data")
    error_json = (
        f"CASE WHEN {ty('$.error')} = 'OBJECT' THEN '{{\"code\":' || CAST(json_extract({v}, '$.error.code') AS VARCHAR) "
        f"|| ',\"message\":' || CAST(json_extract({v}, '$.error.message') AS VARCHAR) "
        f"|| coalesce(',\"data\":' || ({data}), '') || '}}' END"
    )
    return f"""(SELECT * EXCLUDE (_s, _v),
        CASE WHEN kind IN ('request', 'response', 'error') THEN json_extract_string(_v, '$.id') END AS msg_id,
        CASE WHEN kind IN ('request', 'notification') THEN json_extract_string(_v, '$.method') END AS method,
        CASE WHEN kind IN ('request', 'notification') THEN {jtext('$.params')} END AS params_json,
        CASE WHEN kind IN ('response', 'error') THEN {jtext('$.result')} END AS result_json,
        CASE WHEN kind IN ('response', 'error') THEN {error_json} END AS error_json,
        _v
      FROM (SELECT *, {kind} AS kind FROM (
        SELECT *, CASE WHEN json_valid(_s) THEN _s END AS _v FROM (SELECT *, {sql_strip('member')} AS _s FROM {src}))))"""


def sql_parsed_frames() -> str:
    """All frames -> source cleanup -> members -> parsed (keeps ``_v``)."""
    return sql_parse(sql_members(sql_frames_source(P.sql_all_frames())))


def sql_event_kind(k: str) -> str:
    return f"CASE WHEN {k} IN ('request', 'response', 'notification', 'error', 'parse_error') THEN {k} ELSE 'raw' END"
