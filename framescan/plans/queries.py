"""The registered queries (one per operator of the inventory) and their
DuckDB oracles.  Builders only wire library operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import unicode as U
from ..operators import rules as R
from ..operators.scan import rule_hits_long, rule_scan, spread
from ..session import apply_required_conf, written_once
from ..sources import plant as P
from ..sources.keyed import read_keyed
from .catalog import register
from .sqlscan import sql_scan


def _prep(spark):
    apply_required_conf(spark)


# ============================================================ normalisation
@register("nfkc", lambda: f"SELECT doc_id, {U.sql_nfkc('text')} AS text_nfkc FROM {P.sql_docs_planted()}")
def q_nfkc(spark, sf):
    _prep(spark)
    d = spread(P.docs_planted(spark, sf))
    return d.select("doc_id", U.nfkc(F.col("text")).alias("text_nfkc"))


@register("fold_homoglyphs", lambda: f"SELECT doc_id, {U.sql_fold('text')} AS text_folded FROM {P.sql_docs_planted()}")
def q_fold(spark, sf):
    _prep(spark)
    return P.docs_planted(spark, sf).select("doc_id", U.fold_homoglyphs(F.col("text")).alias("text_folded"))


@register(
    "strip_invisible",
    lambda: f"SELECT doc_id, regexp_replace(text, {U._sql_str(U.INVISIBLE_CLASS)}, '', 'g') AS text_visible FROM {P.sql_docs_planted()}",
)
def q_strip(spark, sf):
    _prep(spark)
    return P.docs_planted(spark, sf).select("doc_id", U.strip_invisible(F.col("text")).alias("text_visible"))


@register("normalise_within", lambda: f"SELECT doc_id, {U.sql_within('text')} AS text_within FROM {P.sql_docs_planted()}")
def q_within(spark, sf):
    _prep(spark)
    d = spread(P.docs_planted(spark, sf))
    return d.select("doc_id", U.normalise_within(U.nfkc(F.col("text"))).alias("text_within"))


@register("normalise_between", lambda: f"SELECT doc_id, {U.sql_between('text')} AS text_between FROM {P.sql_docs_planted()}")
def q_between(spark, sf):
    _prep(spark)
    d = spread(P.docs_planted(spark, sf))
    return d.select("doc_id", U.normalise_between(U.nfkc(F.col("text"))).alias("text_between"))


# ================================================================ rule scan
def _corpus(spark, sf):
    """documents (planted), pages (planted html) and conversations as one
    text corpus: ``corpus, item_id, source, text, class_id, expected``."""
    docs = P.docs_planted(spark, sf).select(
        F.lit("documents").alias("corpus"), F.col("doc_id").alias("item_id"), "source", "text", "class_id", "expected"
    )
    pages = P.read_table(spark, sf, "pages")
    pp = P.pick_payload(F.col("page_id"), R.S2C)
    pages = pages.select(
        F.lit("pages").alias("corpus"),
        F.col("page_id").alias("item_id"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("source"),
        F.when(pp.isNotNull(), F.concat(F.col("html"), F.lit("\n"), pp["payload"])).otherwise(F.col("html")).alias("text"),
        pp["class_id"].alias("class_id"),
        pp["expected"].alias("expected"),
    )
    conv = P.read_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("corpus"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"),
        F.col("role").alias("source"),
        "text",
        F.lit(None).cast("string").alias("class_id"),
        F.lit(None).cast("string").alias("expected"),
    )
    return docs.unionByName(pages).unionByName(conv)


def _sql_corpus() -> str:
    pp = P.sql_pick("page_id", R.S2C)
    return f"""(SELECT 'documents' AS corpus, doc_id AS item_id, source, text, class_id, expected FROM {P.sql_docs_planted()}
      UNION ALL
      SELECT 'pages', page_id, regexp_extract(url, '^https?://([^/]+)', 1),
             CASE WHEN pp IS NOT NULL THEN html || chr(10) || pp.payload ELSE html END, pp.class_id, pp.expected
      FROM (SELECT *, {pp} AS pp FROM pages)
      UNION ALL
      SELECT 'conversations', conv_id * 1000 + turn, role, text, NULL, NULL FROM conversations)"""


@register(
    "corpus_scan",
    lambda: f"SELECT corpus, item_id, rules_hit, det_score FROM {sql_scan(_sql_corpus(), ['corpus', 'item_id'], 'text', R.S2C)}",
)
def q_corpus_scan(spark, sf):
    _prep(spark)
    c = spread(_corpus(spark, sf))
    return rule_scan(c, "text", R.S2C).select("corpus", "item_id", "rules_hit", "det_score")


def verdict_by_source(spark, sf):
    """Flagship: scan the planted corpus, count verdict classes per source."""
    _prep(spark)
    c = spread(_corpus(spark, sf))
    s = rule_scan(c, "text", R.S2C)
    verdict = F.when(F.col("det_score") >= 0.85, "BLOCK").when(F.col("det_score") > 0, "WARN").otherwise("PASS")
    return s.groupBy("corpus", "source").agg(
        F.count("*").alias("n_items"),
        F.count_if(verdict == "BLOCK").alias("n_block"),
        F.count_if(verdict == "WARN").alias("n_warn"),
        F.count_if(verdict == "PASS").alias("n_pass"),
        F.round(F.max("det_score"), 4).alias("max_score"),
    )


register(
    "verdict_by_source",
    lambda: f"""SELECT corpus, source, count(*) AS n_items,
        count(*) FILTER (WHERE det_score >= 0.85) AS n_block,
        count(*) FILTER (WHERE det_score > 0 AND det_score < 0.85) AS n_warn,
        count(*) FILTER (WHERE det_score = 0) AS n_pass,
        round(max(det_score), 4) AS max_score
      FROM {sql_scan(_sql_corpus(), ['corpus', 'source'], 'text', R.S2C)}
      GROUP BY corpus, source""",
)(verdict_by_source)


def _single_frames(spark, sf):
    cols = ["frame_id", "direction", "raw"]
    return P.frames_s2c(spark, sf).select(*cols).unionByName(P.frames_c2s(spark, sf).select(*cols))


def _sql_single_frames() -> str:
    return f"(SELECT frame_id, direction, raw FROM {P.sql_frames_s2c()} UNION ALL SELECT frame_id, direction, raw FROM {P.sql_frames_c2s()})"


@register(
    "rule_scan",
    lambda: f"SELECT frame_id, direction, rules_hit, det_score FROM {sql_scan(_sql_single_frames(), ['frame_id', 'direction'], 'raw', 'direction')}",
)
def q_rule_scan(spark, sf):
    _prep(spark)
    f = spread(_single_frames(spark, sf))
    return rule_scan(f, "raw", F.col("direction")).select("frame_id", "direction", "rules_hit", "det_score")


@register(
    "rule_hits_long",
    lambda: f"""SELECT doc_id, hit_pos, rule_id, score FROM (
        SELECT doc_id, (generate_subscripts(h, 1) - 1) AS hit_pos, unnest(h) AS rule_id FROM (
          SELECT doc_id, string_split(rules_hit, ',') AS h FROM {sql_scan(P.sql_docs_planted(), ['doc_id'], 'text', R.S2C)}
          WHERE rules_hit IS NOT NULL))
      JOIN ({R_sql_rules()}) USING (rule_id)""",
)
def q_rule_hits_long(spark, sf):
    _prep(spark)
    d = spread(P.docs_planted(spark, sf))
    s = rule_scan(d, "text", R.S2C)
    rules = R.rules_df(spark).select("rule_id", "score")
    return rule_hits_long(s, ["doc_id"], rules).select("doc_id", F.col("hit_pos").cast("long").alias("hit_pos"), "rule_id", "score")


def R_sql_rules() -> str:
    rows = ", ".join(
        f"({i}, {P._q(r.id)}, {r.score}::DOUBLE, {P._q(','.join(r.apply_to))})" for i, r in enumerate(R.BUILTIN_RULES)
    )
    return f"SELECT * FROM (VALUES {rows}) AS r(rule_order, rule_id, score, apply_to)"


@register(
    "rules_table",
    lambda: f"""SELECT r.rule_order, r.rule_id, r.score, r.apply_to, coalesce(h.n_hits, 0) AS n_hits
      FROM ({R_sql_rules()}) r LEFT JOIN (
        SELECT rule_id, count(*) AS n_hits FROM (
          SELECT unnest(string_split(rules_hit, ',')) AS rule_id FROM {sql_scan(_sql_single_frames(), ['frame_id'], 'raw', 'direction')}
          WHERE rules_hit IS NOT NULL)
        GROUP BY rule_id) h USING (rule_id)""",
)
def q_rules_table(spark, sf):
    """The validated rule set (engine order) with its hit count over all
    single frames of both directions."""
    _prep(spark)
    rules = R.rules_df(spark)
    f = spread(_single_frames(spark, sf))
    hits = (
        rule_hits_long(rule_scan(f, "raw", F.col("direction")), ["frame_id"])
        .groupBy("rule_id")
        .agg(F.count("*").alias("n_hits"))
    )
    # ``hits`` has at most one row per rule: AQE sees its real size at run time
    out = rules.join(hits, "rule_id", "left")
    return out.select(
        "rule_order",
        "rule_id",
        "score",
        F.array_join("apply_to", ",").alias("apply_to"),
        F.coalesce(F.col("n_hits"), F.lit(0)).cast("long").alias("n_hits"),
    )


# =============================================================== evaluation
from ..operators import evaluate as EV  # noqa: E402


def _scanned_attacks(spark, sf):
    a = spread(EV.valid_attacks(P.attacks(spark, sf)))
    return rule_scan(a, "text", F.col("direction"))


def _sql_scanned_attacks() -> str:
    return sql_scan(P.sql_attacks(), ["item_id", "class_id", "attack_id", "direction", "expected"], "text", "direction")


@register(
    "attacks_source",
    lambda: f"""SELECT item_id, class_id, attack_id, direction, expected, length(text) AS n_chars FROM {P.sql_attacks()}
      WHERE direction IN ('client_to_server', 'server_to_client') AND expected IN ('catch', 'evade')
        AND length(trim(class_id)) > 0 AND length(trim(attack_id)) > 0 AND length(trim(text)) > 0""",
)
def q_attacks_source(spark, sf):
    _prep(spark)
    a = EV.valid_attacks(P.attacks(spark, sf))
    return a.select("item_id", "class_id", "attack_id", "direction", "expected", F.length("text").cast("long").alias("n_chars"))


_SQL_EVAL = """SELECT class_id, first(direction) AS direction, first(expected) AS expected, count(*) AS n_attacks,
      count(*) FILTER (WHERE rules_hit IS NOT NULL) AS caught, count(*) FILTER (WHERE rules_hit IS NULL) AS evaded,
      round(count(*) FILTER (WHERE rules_hit IS NOT NULL) * 100.0 / count(*), 2)::DOUBLE AS detect_pct,
      CASE WHEN (first(expected) = 'catch' AND count(*) FILTER (WHERE rules_hit IS NULL) = 0)
             OR (first(expected) = 'evade' AND count(*) FILTER (WHERE rules_hit IS NOT NULL) = 0) THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM {src} GROUP BY class_id"""


@register("attack_eval", lambda: _SQL_EVAL.format(src=_sql_scanned_attacks()))
def q_attack_eval(spark, sf):
    _prep(spark)
    return EV.attack_eval(_scanned_attacks(spark, sf))


@register(
    "attack_eval_overall",
    lambda: f"""SELECT count(*) AS n_classes, sum(n_attacks) AS n_attacks, sum(caught) AS caught,
        round(sum(caught) * 100.0 / sum(n_attacks), 2)::DOUBLE AS overall_pct,
        CASE WHEN bool_and(status = 'OK') THEN 'PASS' ELSE 'FAIL' END AS status,
        coalesce(array_to_string(list_sort(list(class_id) FILTER (WHERE expected = 'catch' AND evaded > 0)), ','), '') AS failing_catch_classes
      FROM ({_SQL_EVAL.format(src=_sql_scanned_attacks())})""",
)
def q_attack_eval_overall(spark, sf):
    _prep(spark)
    return EV.attack_eval_overall(EV.attack_eval(_scanned_attacks(spark, sf)))


@register(
    "rule_quality",
    lambda: f"""WITH s AS (SELECT * FROM {sql_scan(_sql_corpus_labelled(), ['item_id', 'attack_id'], 'text', 'direction', raw_only=True)}),
      r AS ({R_sql_rules()}),
      bh AS (SELECT rule_id, count(*) AS benign_matched FROM (SELECT unnest(string_split(rules_hit, ',')) AS rule_id FROM s WHERE attack_id IS NULL AND rules_hit IS NOT NULL) GROUP BY rule_id),
      atk AS (SELECT target_rule AS rule_id, count(*) AS attack_examples,
               count(*) FILTER (WHERE NOT coalesce(list_contains(string_split(rules_hit, ','), target_rule), false)) AS attack_missed
             FROM s JOIN {P.sql_attack_targets()} USING (attack_id) GROUP BY target_rule)
      SELECT r.rule_id, coalesce(atk.attack_examples, 0) AS attack_examples, coalesce(atk.attack_missed, 0) AS attack_missed,
             (SELECT count(*) FROM s WHERE attack_id IS NULL) AS benign_examples, coalesce(bh.benign_matched, 0) AS benign_matched
      FROM r LEFT JOIN atk USING (rule_id) LEFT JOIN bh USING (rule_id)""",
)
def q_rule_quality(spark, sf):
    """Every rule against the texts of its directions: documents and pages, and the users' tool calls (raw view only)."""
    _prep(spark)
    c = spread(_corpus_labelled(spark, sf))
    s = rule_scan(c, "text", F.col("direction"), raw_only=True)
    targets = spark.createDataFrame(list(P.ATTACK_TARGETS.items()), "attack_id string, target_rule string")
    return EV.rule_quality(s, targets, R.rules_df(spark))


@register(
    "rule_examples",
    lambda: f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({P._q(r.id)}, {P._q(r.re2_pattern)}, {i})" for i, r in enumerate(R.BUILTIN_RULES))}) AS t(rule_id, pattern, nth)),
      e AS (SELECT target_rule AS rule_id, true AS attack, text FROM {P.sql_attacks()} JOIN {P.sql_attack_targets()} USING (attack_id)
            UNION ALL SELECT r.rule_id, false, d.text FROM documents d JOIN r ON d.doc_id % {len(R.BUILTIN_RULES)} = r.nth),
      h AS (SELECT rule_id, attack, regexp_matches(text, pattern) AS hit FROM e JOIN r USING (rule_id) WHERE text IS NOT NULL),
      g AS (SELECT rule_id, count(*) FILTER (WHERE attack) AS attack_examples, count(*) FILTER (WHERE attack AND NOT hit) AS attack_missed,
              count(*) FILTER (WHERE NOT attack) AS benign_examples, count(*) FILTER (WHERE NOT attack AND hit) AS benign_matched FROM h GROUP BY rule_id)
      SELECT r.rule_id, coalesce(attack_examples, 0) AS attack_examples, coalesce(attack_missed, 0) AS attack_missed,
        coalesce(benign_examples, 0) AS benign_examples, coalesce(benign_matched, 0) AS benign_matched,
        CASE WHEN attack_missed > 0 OR benign_matched > 0 THEN 'drifted' WHEN coalesce(attack_examples, 0) = 0 THEN 'no_examples' ELSE 'ok' END AS status
      FROM r LEFT JOIN g USING (rule_id)""",
)
def q_rule_examples(spark, sf):
    """Examples of each rule taken from the tables: the attacks written for it, and the documents dealt to it as benign."""
    _prep(spark)
    targets = spark.createDataFrame(list(P.ATTACK_TARGETS.items()), "attack_id string, rule_id string")
    attacks = P.attacks(spark, sf).join(targets, "attack_id").select("rule_id", F.lit(True).alias("attack"), "text")
    ids = F.array(*[F.lit(r.id) for r in R.BUILTIN_RULES])
    dealt = F.try_element_at(ids, (F.col("doc_id") % len(R.BUILTIN_RULES) + 1).cast("int"))
    benign = P.read_table(spark, sf, "documents").select(dealt.alias("rule_id"), F.lit(False).alias("attack"), "text")
    return EV.rule_examples(attacks.unionByName(benign), R.patterns_df(spark))


def _corpus_labelled(spark, sf):
    s2c, c2s = F.lit(R.S2C).alias("direction"), F.lit(R.C2S).alias("direction")
    docs = P.docs_planted(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("item_id"), s2c, "attack_id", "text")
    pages = P.read_table(spark, sf, "pages")
    pp = P.pick_payload(F.col("page_id"), R.S2C)
    pages = pages.select(
        F.concat(F.lit("p"), F.col("page_id")).alias("item_id"),
        s2c,
        pp["attack_id"].alias("attack_id"),
        F.when(pp.isNotNull(), F.concat(F.col("html"), F.lit("\n"), pp["payload"])).otherwise(F.col("html")).alias("text"),
    )
    calls = P.frames_c2s(spark, sf).select(F.concat(F.lit("c"), F.col("frame_id")).alias("item_id"), c2s, "attack_id", F.col("raw").alias("text"))
    return docs.unionByName(pages).unionByName(calls)


def _sql_corpus_labelled() -> str:
    pp = P.sql_pick("page_id", R.S2C)
    return f"""(SELECT 'd' || doc_id AS item_id, '{R.S2C}' AS direction, attack_id, text FROM {P.sql_docs_planted()}
      UNION ALL SELECT 'c' || frame_id, '{R.C2S}', attack_id, raw FROM {P.sql_frames_c2s()}
      UNION ALL SELECT 'p' || page_id, '{R.S2C}', pp.attack_id, CASE WHEN pp IS NOT NULL THEN html || chr(10) || pp.payload ELSE html END
      FROM (SELECT *, {pp} AS pp FROM pages))"""


# =================================================================== frames
from ..functions.jsonrpc import argv_text as _argv_text  # noqa: E402
from ..operators import frames as FR  # noqa: E402
from . import sqlframes as SF  # noqa: E402
from .sqlscan import sql_argv  # noqa: E402


def _frames(spark, sf):
    return FR.frames_source(P.all_frames(spark, sf))


def _parsed(spark, sf):
    return FR.parse_frame(FR.split_batch(spread(_frames(spark, sf))))


@register("frames_source", lambda: f"SELECT frame_id, session_id, ts, direction, raw FROM {SF.sql_frames_source(P.sql_all_frames())}")
def q_frames_source(spark, sf):
    _prep(spark)
    return _frames(spark, sf).select("frame_id", "session_id", "ts", "direction", "raw")


@register(
    "frame_lines",
    lambda: f"""SELECT direction, raw, count(*) AS n_lines, count(*) AS n_ids
      FROM {SF.sql_frames_source(P.sql_all_frames())} WHERE NOT contains(raw, chr(10)) GROUP BY direction, raw""",
)
def q_frame_lines(spark, sf):
    """The frames written as text files, one folder a direction, and read back
    by ``read_frame_lines``: every line is there as often as it was written, each with an id of its own."""
    _prep(spark)
    path = AU.scratch_path(spark, "lines")
    whole = P.all_frames(spark, sf).where(~F.col("raw").contains("\n"))
    whole.select("direction", F.col("raw").alias("value")).write.partitionBy("direction").text(path)
    read = [FR.frames_source(FR.read_frame_lines(spark, f"{path}/direction={d}", d)) for d in R.DIRECTIONS]
    lines = read[0].unionByName(read[1])
    each = lines.groupBy("direction", "raw", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("direction", "raw").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_ids"))


@register(
    "oversize_frames",
    lambda: f"""SELECT frame_id, strlen(raw) AS n_bytes, strlen(raw) > {FR.LINE_LIMIT_BYTES} AS oversize,
        CASE WHEN strlen(raw) > {FR.LINE_LIMIT_BYTES} THEN 'raw' END AS kind,
        CASE WHEN strlen(raw) > {FR.LINE_LIMIT_BYTES} THEN 'line_limit_exceeded' END AS note
      FROM {SF.sql_frames_source(P.sql_all_frames())}""",
)
def q_oversize(spark, sf):
    _prep(spark)
    f = FR.oversize_flag(_frames(spark, sf))
    return f.select(
        "frame_id", "n_bytes", "oversize",
        F.when(F.col("oversize"), "raw").alias("kind"),
        F.when(F.col("oversize"), "line_limit_exceeded").alias("note"),
    )


@register(
    "split_batch",
    lambda: f"SELECT frame_id, pos, n_members, is_batch, member FROM {SF.sql_members(SF.sql_frames_source(P.sql_all_frames()))}",
)
def q_split_batch(spark, sf):
    _prep(spark)
    m = FR.split_batch(spread(_frames(spark, sf)))
    return m.select("frame_id", F.col("pos").cast("long").alias("pos"), F.col("n_members").cast("long").alias("n_members"), "is_batch", "member")


@register("parse_frame", lambda: f"SELECT frame_id, pos, kind FROM {SF.sql_parsed_frames()}")
def q_parse_frame(spark, sf):
    _prep(spark)
    return _parsed(spark, sf).select("frame_id", F.col("pos").cast("long").alias("pos"), "kind")


_EVENT_COLS = "frame_id, pos, session_id, ts, direction, {kind} AS kind, msg_id, method, params_json, result_json, error_json, member AS raw"


@register("event_columns", lambda: f"SELECT {_EVENT_COLS.format(kind=SF.sql_event_kind('kind'))} FROM {SF.sql_parsed_frames()}")
def q_event_columns(spark, sf):
    _prep(spark)
    return FR.event_columns(_parsed(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@register(
    "valid_events",
    lambda: f"""SELECT frame_id, pos, direction, kind FROM (SELECT {_EVENT_COLS.format(kind=SF.sql_event_kind('kind'))} FROM {SF.sql_parsed_frames()})
      WHERE direction IN ('client_to_server', 'server_to_client')
        AND kind IN ('request', 'response', 'notification', 'error', 'raw', 'parse_error')""",
)
def q_valid_events(spark, sf):
    _prep(spark)
    ev = FR.valid_events(FR.settled(FR.event_columns(_parsed(spark, sf)), "kind"))
    return ev.select("frame_id", F.col("pos").cast("long").alias("pos"), "direction", "kind")


def _sql_result_text() -> str:
    v = "_v"
    blocks = (
        f"list_filter(json_extract({v}, '$.result.content[*]'), lambda b: json_type(b) = 'OBJECT' "
        f"AND coalesce(json_type(b, '$.type') = 'VARCHAR' AND json_extract_string(b, '$.type') = 'text', false) "
        f"AND coalesce(json_type(b, '$.text') = 'VARCHAR', false))"
    )
    is_cand = (
        f"(kind IN ('response', 'error') AND json_type({v}, '$.result') = 'OBJECT' "
        f"AND json_type({v}, '$.result.content') = 'ARRAY' AND json_array_length({v}, '$.result.content') > 0)"
    )
    return f"""SELECT frame_id, pos, shape_note, CASE WHEN shape_note = 'candidate' THEN array_to_string(list_transform(_blocks, lambda b: json_extract_string(b, '$.text')), chr(10)) END AS result_text
      FROM (SELECT frame_id, pos, _blocks,
              CASE WHEN NOT coalesce({is_cand}, false) THEN 'skipped:not_candidate'
                   WHEN len(_blocks) = 0 THEN 'skipped:non_text_content' ELSE 'candidate' END AS shape_note
            FROM (SELECT *, CASE WHEN coalesce({is_cand}, false) THEN {blocks} END AS _blocks FROM {SF.sql_parsed_frames()}))"""


@register("tool_result_text", _sql_result_text)
def q_tool_result_text(spark, sf):
    _prep(spark)
    t = FR.tool_result_text(_parsed(spark, sf))
    return t.select("frame_id", F.col("pos").cast("long").alias("pos"), "shape_note", "result_text")


@register(
    "argv_text",
    lambda: f"""SELECT frame_id, pos, {sql_argv('member')} AS argv FROM {SF.sql_members(SF.sql_frames_source(P.sql_all_frames()))}
      WHERE direction = 'client_to_server'""",
)
def q_argv_text(spark, sf):
    _prep(spark)
    m = FR.split_batch(spread(_frames(spark, sf))).where(F.col("direction") == R.C2S)
    return m.select("frame_id", F.col("pos").cast("long").alias("pos"), _argv_text(F.col("member")).alias("argv"))


@register(
    "tool_name",
    lambda: f"""SELECT frame_id, pos, '{P.SERVER_NAME}.' || json_extract_string(_v, '$.params.name') AS tool FROM {SF.sql_parsed_frames()}
      WHERE kind = 'request' AND method = 'tools/call' AND json_type(_v, '$.params') = 'OBJECT'
        AND json_type(_v, '$.params.name') = 'VARCHAR' AND json_extract_string(_v, '$.params.name') <> ''""",
)
def q_tool_name(spark, sf):
    _prep(spark)
    t = FR.settled(FR.tool_name(_parsed(spark, sf), P.SERVER_NAME), "tool")
    return t.where(F.col("tool").isNotNull()).select("frame_id", F.col("pos").cast("long").alias("pos"), "tool")


def _sql_payload_summary() -> str:
    src = "coalesce(nullif(params_json, ''), nullif(result_json, ''), nullif(error_json, ''), member)"
    s = SF.sql_strip(src)
    compact = f"CASE WHEN json_valid({s}) THEN CAST(json({s}) AS VARCHAR) ELSE {s} END"
    return f"""SELECT frame_id, pos, CASE WHEN length(c) > 120 THEN left(c, 119) || '…' ELSE c END AS summary,
        strftime(ts, '%H:%M:%S.%g') AS short_ts
      FROM (SELECT frame_id, pos, ts, {compact} AS c FROM {SF.sql_parsed_frames()})"""


@register("payload_summary", _sql_payload_summary)
def q_payload_summary(spark, sf):
    _prep(spark)
    p = _parsed(spark, sf).withColumn("raw", F.col("member"))
    return FR.payload_summary(p).select("frame_id", F.col("pos").cast("long").alias("pos"), "summary", "short_ts")


@register(
    "parse_errors",
    lambda: f"SELECT frame_id, pos, direction, member AS raw FROM {SF.sql_parsed_frames()} WHERE kind = 'parse_error'",
)
def q_parse_errors(spark, sf):
    _prep(spark)
    p = FR.settled(_parsed(spark, sf), "kind")
    return p.where(F.col("kind") == "parse_error").select("frame_id", F.col("pos").cast("long").alias("pos"), "direction", F.col("member").alias("raw"))


# ============================================================ decisions/inspect
from ..operators import inspect as IN  # noqa: E402
from ..operators.policy import decide  # noqa: E402
from . import sqlinspect as SI  # noqa: E402


def _inspection(spark, sf, **kw):
    kw.setdefault("allowed_tools", list(SI.ALLOWED_TOOLS))
    kw.setdefault("server_name", P.SERVER_NAME)
    kw.setdefault("once", False)
    return IN.inspect_frames(P.all_frames(spark, sf), **kw)


def _pos(c="pos"):
    return F.col(c).cast("long").alias(c)


@register(
    "capability_check",
    lambda: f"""{SI.sql_inspect_with()}
      SELECT frame_id, pos, tool, CASE WHEN tool IN ({', '.join(P._q(t) for t in SI.ALLOWED_TOOLS)}) THEN 'in_allowlist' ELSE 'not_in_allowlist' END AS cap_reason,
             cap_blocked FROM m WHERE direction = 'client_to_server' AND tool IS NOT NULL""",
)
def q_capability_check(spark, sf):
    _prep(spark)
    m = _inspection(spark, sf, once=True).members
    return m.where((F.col("direction") == R.C2S) & F.col("tool").isNotNull()).select("frame_id", _pos(), "tool", "cap_reason", "cap_blocked")


@register(
    "policy_decide",
    lambda: f"{SI.sql_inspect_with()} SELECT frame_id, pos, policy_action, matched_policy, policy_message FROM m",
)
def q_policy_decide(spark, sf):
    _prep(spark)
    m = _inspection(spark, sf).members
    return m.select("frame_id", _pos(), "policy_action", "matched_policy", "policy_message")


@register("verdict", lambda: f"{SI.sql_inspect_with()} SELECT frame_id, pos, det_action, det_verdict FROM m")
def q_verdict(spark, sf):
    _prep(spark)
    return _inspection(spark, sf).members.select("frame_id", _pos(), "det_action", "det_verdict")


@register("block_reply", lambda: f"{SI.sql_inspect_with()} SELECT frame_id, pos, reply FROM m WHERE reply IS NOT NULL")
def q_block_reply(spark, sf):
    _prep(spark)
    m = _inspection(spark, sf, once=True).members
    return m.where(F.col("reply").isNotNull()).select("frame_id", _pos(), "reply")


@register(
    "block_downgrade",
    lambda: f"{SI.sql_inspect_with()} SELECT frame_id, pos, det_verdict, det_action, note FROM m WHERE policy_action = 'block'",
)
def q_block_downgrade(spark, sf):
    _prep(spark)
    m = _inspection(spark, sf, once=True).members
    return m.where(F.col("policy_action") == "block").select("frame_id", _pos(), "det_verdict", "det_action", "note")


_AUDIT_OUT = "frame_id, pos, session_id, ts, direction, kind, msg_id, method, params_json, result_json, error_json, raw, note, det_verdict, det_score, det_rules, det_classifier, det_latency_ms, det_action"


def _audit_out(ev):
    return ev.select(
        "frame_id", _pos(), "session_id", "ts", "direction", "kind", "msg_id", "method", "params_json", "result_json",
        "error_json", "raw", "note", "det_verdict", "det_score", F.array_join("det_rules", ",").alias("det_rules"),
        "det_classifier", "det_latency_ms", "det_action",
    )


@register(
    "capability_blocks",
    lambda: f"""{SI.sql_inspect_with()} SELECT frame_id, pos, note, params_json, det_verdict, det_action FROM a
      WHERE frame_id IN (SELECT frame_id FROM o WHERE frame_cap) UNION ALL
      SELECT frame_id, -2, reply_line, NULL, NULL, NULL FROM o WHERE frame_cap""",
)
def q_capability_blocks(spark, sf):
    """Audit rows of capability-blocked frames, plus each frame's reply line (pos -2)."""
    _prep(spark)
    ins = _inspection(spark, sf, once=True)
    capf = ins.members.where("cap_blocked").select("frame_id").distinct()
    rows = ins.events.join(capf, "frame_id", "left_semi").select("frame_id", _pos(), "note", "params_json", "det_verdict", "det_action")
    rep = ins.replies.join(capf, "frame_id", "left_semi").select(
        "frame_id", F.lit(-2).cast("long").alias("pos"), F.col("reply_line").alias("note"),
        *[F.lit(None).cast("string").alias(c) for c in ("params_json", "det_verdict", "det_action")],
    )
    return rows.unionByName(rep)


@register(
    "batch_abort",
    lambda: f"""{SI.sql_inspect_with()} SELECT frame_id, direction, reply_line FROM o
      WHERE reply_line IS NOT NULL AND frame_id IN (SELECT frame_id FROM m WHERE n_members > 1)""",
)
def q_batch_abort(spark, sf):
    _prep(spark)
    ins = _inspection(spark, sf, once=True)
    batch_ids = ins.members.where(F.col("n_members") > 1).select("frame_id").distinct()
    return ins.replies.join(batch_ids, "frame_id", "left_semi").select("frame_id", "direction", "reply_line")


@register("synthetic_events", lambda: f"{SI.sql_inspect_with()} SELECT {_AUDIT_OUT} FROM a WHERE note = 'synthetic-block'")
def q_synthetic_events(spark, sf):
    _prep(spark)
    ev = _inspection(spark, sf).events
    return _audit_out(ev.where(F.col("note") == "synthetic-block"))


@register("inspect_frames", lambda: f"{SI.sql_inspect_with()} SELECT {_AUDIT_OUT} FROM a")
def q_inspect_frames(spark, sf):
    _prep(spark)
    return _audit_out(_inspection(spark, sf).events)


# ==================================================================== audit
import datetime as _dt  # noqa: E402

from ..operators import stats as ST  # noqa: E402
from ..sources import audit as AU  # noqa: E402

WIN_END = _dt.datetime(2024, 1, 31)
WIN_START = WIN_END - ST.parse_since("7d")
EVOLVE_AT = "2024-01-15 00:00:00"
RETENTION_NOW = "2024-01-31 00:00:00"
RETENTION_DAYS = 10
_AUD = "event_id, session_id, ts, direction, kind, msg_id, method, params_json, result_json, error_json, raw, note, det_verdict, det_score, array_to_string(det_rules, ',') AS det_rules, det_classifier, det_latency_ms, det_action"
_SQL_WIN = f"ts >= TIMESTAMP '{WIN_START:%Y-%m-%d %H:%M:%S}' AND ts < TIMESTAMP '{WIN_END:%Y-%m-%d %H:%M:%S}'"


def _audit_cols(df):
    return df.select(*[F.array_join("det_rules", ",").alias("det_rules") if c == "det_rules" else c for c in AU.AUDIT_COLUMNS])


@register("audit_write", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()}")
def q_audit_write(spark, sf):
    """Append the derived audit rows (date-partitioned Parquet under the
    shared checkpoint folder) and read them back."""
    _prep(spark)
    path = AU.scratch_path(spark, "audit")
    AU.audit_write(AU.audit_like(spark, sf), path)
    return _audit_cols(AU.audit_read(spark, path))


@register(
    "audit_read_evolved",
    lambda: f"""SELECT event_id, session_id, ts, direction, kind, msg_id, method, params_json, result_json, error_json, raw, note,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN det_verdict END AS det_verdict,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN det_score END AS det_score,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN array_to_string(det_rules, ',') END AS det_rules,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN det_classifier END AS det_classifier,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN det_latency_ms END AS det_latency_ms,
        CASE WHEN ts >= TIMESTAMP '{EVOLVE_AT}' THEN det_action END AS det_action
      FROM {AU.sql_audit_like()}""",
)
def q_audit_read_evolved(spark, sf):
    """Rows before the cut-over are written with the v1 schema (no detector
    columns), later rows with v2; both are read back as one table."""
    _prep(spark)
    path = AU.scratch_path(spark, "audit-evolved")
    a = AU.audit_like(spark, sf)
    cut = F.col("ts") >= F.lit(EVOLVE_AT).cast("timestamp")
    AU.audit_write(a.where(~cut).select(*AU.V1_COLUMNS), path)
    AU.audit_write(a.where(cut), path)
    return _audit_cols(AU.audit_read(spark, path))


_SQL_SESSIONS = """(SELECT session_id,
      max(CASE WHEN op = 'start' THEN ts END) AS started_at,
      arg_max(pid, CASE WHEN op = 'pid' THEN ts END) AS server_pid,
      max(CASE WHEN op = 'end' THEN ts END) AS ended_at,
      arg_max(exit_code, CASE WHEN op = 'end' THEN ts END) AS exit_code
    FROM (SELECT user_id AS session_id, ts,
            CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'pid' WHEN 'error' THEN 'end' ELSE 'seen' END AS op,
            CASE WHEN event_type = 'purchase' THEN event_id % 65536 END AS pid,
            CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INTEGER) % 3 END AS exit_code
          FROM events)
    GROUP BY session_id)"""


@register("sessions_table", lambda: f"SELECT * FROM {_SQL_SESSIONS}")
def q_sessions_table(spark, sf):
    _prep(spark)
    return AU.sessions_table(AU.session_events(spark, sf))


@register("sessions_incremental", lambda: f"SELECT * FROM {_SQL_SESSIONS}")
def q_sessions_incremental(spark, sf):
    """The sessions table kept up to date by four batches of events, the last
    days first; the table's parts hold one row a session, no event is read twice."""
    _prep(spark)
    path = AU.scratch_path(spark, "sessions")
    ev = AU.session_events(spark, sf)
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for n in (3, 0, 2, 1):
        AU.upsert_sessions(ev.where(F.coalesce(week, F.lit(0)) == n), path)
    return AU.read_sessions(spark, path)


@register("recent_sessions", lambda: f"SELECT * FROM {_SQL_SESSIONS} ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 5")
def q_recent_sessions(spark, sf):
    _prep(spark)
    return ST.recent_sessions(AU.sessions_table(AU.session_events(spark, sf)))


@register(
    "retention",
    lambda: f"SELECT event_id, ts, det_verdict FROM {AU.sql_audit_like()} WHERE ts >= TIMESTAMP '{RETENTION_NOW}' - INTERVAL {RETENTION_DAYS} DAY",
)
def q_retention(spark, sf):
    """Keep rows younger than 10 days at a fixed 'now' (date-partitioned log:
    older partitions are skipped by partition pruning)."""
    _prep(spark)
    path = AU.scratch_path(spark, "audit-ret")
    AU.audit_write(AU.audit_like(spark, sf), path)
    return AU.apply_retention(spark, path, RETENTION_DAYS, RETENTION_NOW).select("event_id", "ts", "det_verdict")


@register(
    "stats_verdicts",
    lambda: f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE det_verdict = 'PASS') AS n_pass,
        count(*) FILTER (WHERE det_verdict = 'WARN') AS n_warn, count(*) FILTER (WHERE det_verdict = 'BLOCK') AS n_block
      FROM {AU.sql_audit_like()} WHERE {_SQL_WIN}""",
)
def q_stats_verdicts(spark, sf):
    _prep(spark)
    return ST.stats_verdicts(ST.window(AU.audit_like(spark, sf), WIN_START, WIN_END))


_SQL_TOP = f"""SELECT row_number() OVER (ORDER BY cnt DESC, first_k, first_p) AS rank, rule_id, cnt AS count FROM (
      SELECT rule_id, count(*) AS cnt, min(event_id) AS first_k, arg_min(p, event_id * 100 + p) AS first_p FROM (
        SELECT event_id, unnest(det_rules) AS rule_id, unnest(generate_series(0, len(det_rules) - 1)) AS p
        FROM {AU.sql_audit_like()} WHERE {_SQL_WIN} AND det_rules IS NOT NULL)
      GROUP BY rule_id)
    QUALIFY rank <= 5"""


@register("stats_top_rules", lambda: _SQL_TOP)
def q_stats_top_rules(spark, sf):
    _prep(spark)
    return ST.stats_top_rules(ST.window(AU.audit_like(spark, sf), WIN_START, WIN_END))


@register(
    "stats_latency",
    lambda: f"""SELECT quantile_cont(det_latency_ms::DOUBLE, 0.5) AS latency_p50_ms, quantile_cont(det_latency_ms::DOUBLE, 0.95) AS latency_p95_ms,
        count(*) AS n_samples FROM {AU.sql_audit_like()} WHERE {_SQL_WIN} AND det_latency_ms IS NOT NULL""",
)
def q_stats_latency(spark, sf):
    _prep(spark)
    return ST.stats_latency(ST.window(AU.audit_like(spark, sf), WIN_START, WIN_END))


@register(
    "stats_report",
    lambda: f"""SELECT 1 AS schema_version, TIMESTAMP '{WIN_START:%Y-%m-%d %H:%M:%S}' AS period_start, TIMESTAMP '{WIN_END:%Y-%m-%d %H:%M:%S}' AS period_end,
        v.*, (SELECT string_agg(rule_id || ':' || count, ',' ORDER BY rank) FROM ({_SQL_TOP})) AS top_rules,
        l.latency_p50_ms, l.latency_p95_ms
      FROM (SELECT count(*) AS total_events, count(*) FILTER (WHERE det_verdict = 'PASS') AS n_pass,
              count(*) FILTER (WHERE det_verdict = 'WARN') AS n_warn, count(*) FILTER (WHERE det_verdict = 'BLOCK') AS n_block
            FROM {AU.sql_audit_like()} WHERE {_SQL_WIN}) v,
           (SELECT quantile_cont(det_latency_ms::DOUBLE, 0.5) AS latency_p50_ms, quantile_cont(det_latency_ms::DOUBLE, 0.95) AS latency_p95_ms
            FROM {AU.sql_audit_like()} WHERE {_SQL_WIN}) l""",
)
def q_stats_report(spark, sf):
    _prep(spark)
    return ST.stats_report(AU.audit_like(spark, sf), WIN_START, WIN_END)


@register("log_snapshot", lambda: f"SELECT count(*) AS total_events, arg_max(ts, event_id) AS last_event_ts FROM {AU.sql_audit_like()}")
def q_log_snapshot(spark, sf):
    _prep(spark)
    return ST.log_snapshot(AU.audit_like(spark, sf))


@register(
    "usage_rollup",
    lambda: f"""SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(*) FILTER (WHERE det_verdict = 'PASS') AS n_pass,
        count(*) FILTER (WHERE det_verdict = 'WARN') AS n_warn, count(*) FILTER (WHERE det_verdict = 'BLOCK') AS n_block
      FROM {AU.sql_audit_like()} GROUP BY 1""",
)
def q_usage_rollup(spark, sf):
    _prep(spark)
    return ST.usage_rollup(AU.audit_like(spark, sf))


@register("tail", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE det_verdict = 'BLOCK' ORDER BY event_id DESC LIMIT 20")
def q_tail(spark, sf):
    """Newest 20 BLOCK rows, oldest first (a top-k report)."""
    _prep(spark)
    return _audit_cols(ST.tail(AU.audit_like(spark, sf), 20, "BLOCK"))


@register("page_since", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE event_id > 5000 ORDER BY event_id LIMIT 100")
def q_page_since(spark, sf):
    """One cursor page: 100 rows after event 5000."""
    _prep(spark)
    return _audit_cols(ST.page_since(AU.audit_like(spark, sf), 5000, 100))


@register(
    "corpus_scan_raw_only",
    lambda: f"SELECT corpus, item_id, rules_hit, det_score FROM {sql_scan(_sql_corpus(), ['corpus', 'item_id'], 'text', R.S2C, raw_only=True)}",
)
def q_corpus_scan_raw_only(spark, sf):
    """The corpus scan on the raw view alone (no NFKC / fold / invisible
    views): the lint semantics, and the cost baseline of the normalised views."""
    _prep(spark)
    c = spread(_corpus(spark, sf))
    return rule_scan(c, "text", R.S2C, raw_only=True).select("corpus", "item_id", "rules_hit", "det_score")


# =============================================================== classifier
import pandas as _pd  # noqa: E402

from ..operators import classify as CL  # noqa: E402

CLS_NOW = "2024-01-01 12:00:00"


def parity_model(samples: _pd.Series) -> _pd.Series:
    """Deterministic stand-in model (SQL-expressible, so the classifier stage
    gets a real oracle), by the number n of letters 'e' in the sample: n odd ->
    'Instruction.', even -> 'DATA', n divisible by 11 -> an unparseable answer."""
    n = samples.str.count("e")
    out = _pd.Series(["DATA"] * len(samples), index=samples.index, dtype=object)
    out[n % 2 == 1] = "Instruction."
    out[n % 11 == 0] = "??"
    return out


def _cls_members(spark, sf):
    """Server->client single frames, parsed, text extracted, rule-scanned."""
    m = FR.parse_frame(FR.split_batch(spread(FR.frames_source(P.frames_s2c(spark, sf).select("frame_id", "session_id", "ts", "direction", "raw")))))
    m = FR.tool_result_text(m)
    return rule_scan(m, "member", R.S2C)


def _sql_cls_members() -> str:
    src = SF.sql_parse(SF.sql_members(SF.sql_frames_source(f"(SELECT frame_id, session_id, ts, direction, raw FROM {P.sql_frames_s2c()})")))
    v = "_v"
    blocks = (
        f"list_filter(json_extract({v}, '$.result.content[*]'), lambda b: json_type(b) = 'OBJECT' "
        f"AND coalesce(json_type(b, '$.type') = 'VARCHAR' AND json_extract_string(b, '$.type') = 'text', false) "
        f"AND coalesce(json_type(b, '$.text') = 'VARCHAR', false))"
    )
    is_cand = (
        f"(kind IN ('response', 'error') AND json_type({v}, '$.result') = 'OBJECT' "
        f"AND json_type({v}, '$.result.content') = 'ARRAY' AND json_array_length({v}, '$.result.content') > 0)"
    )
    texts = f"""(SELECT * EXCLUDE (_blocks), CASE WHEN shape_note = 'candidate' THEN array_to_string(list_transform(_blocks, lambda b: json_extract_string(b, '$.text')), chr(10)) END AS result_text
      FROM (SELECT *, CASE WHEN NOT coalesce({is_cand}, false) THEN 'skipped:not_candidate'
                   WHEN len(_blocks) = 0 THEN 'skipped:non_text_content' ELSE 'candidate' END AS shape_note
            FROM (SELECT *, CASE WHEN coalesce({is_cand}, false) THEN {blocks} END AS _blocks FROM {src})))"""
    return sql_scan(texts, ["* EXCLUDE (_x, _r, _w, _b)"], "member", R.S2C)


def _sql_gate(direction="direction", score="det_score", shape="shape_note", text="result_text") -> str:
    return f"""CASE WHEN {direction} <> '{R.S2C}' THEN 'skipped:c2s' WHEN {score} >= {CL.SHORT_CIRCUIT} THEN 'skipped:rules_short_circuit'
      WHEN {shape} <> 'candidate' THEN {shape} ELSE 'candidate' END"""


def _sql_candidates() -> str:
    """One row per window of a candidate's text, with its hash."""
    clean = "result_text"
    for a, b in CL.SANITISE:
        clean = f"replace({clean}, {P._q(a)}, {P._q(b)})"
    return f"""(SELECT *, sha256(sample) AS content_hash FROM (
        SELECT *, unnest(list_transform(range(0, n_windows), lambda i: substr(clean, i * {CL.STEP_CHARS} + 1, {CL.WINDOW_CHARS}))) AS sample FROM (
          SELECT *, CAST(greatest(1, ceil((length(clean) - {CL.OVERLAP_CHARS}) / {CL.STEP_CHARS}::DOUBLE)) AS BIGINT) AS n_windows FROM (
            SELECT *, {clean} AS clean FROM (
              SELECT *, {_sql_gate()} AS gate FROM {_sql_cls_members()}) WHERE gate = 'candidate' AND {SF.sql_strip('result_text')} <> ''))))"""


def _cache_prev(spark, cand):
    """A previous run's cache built from the even frames: label from the hash,
    an invalid label for hashes ending in '0', cached over the two days before
    'now' so that about half the entries are expired."""
    prev = cand.where(F.col("frame_id") % 2 == 0).select(
        "frame_id",
        "content_hash",
        F.when(F.col("content_hash").endswith("0"), "MAYBE").when(F.substring("content_hash", 1, 1) < "8", "DATA").otherwise("INSTRUCTION").alias("classifier"),
        F.when(F.substring("content_hash", 1, 1) < "8", CL.DATA_SCORE).otherwise(CL.INSTRUCTION_SCORE).alias("score"),
        (F.lit("2023-12-31 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("frame_id") * 97) % 172800).cast("decimal(18,6)"))).alias("cached_at"),
        F.lit("previous").alias("backend"),
    )
    # one entry per hash: the lowest frame id wins (deterministic)
    return prev.groupBy("content_hash").agg(
        F.min_by(F.struct("classifier", "score", "cached_at", "backend"), "frame_id").alias("r")
    ).select("content_hash", "r.*")


def _sql_cache_prev() -> str:
    return f"""(SELECT content_hash, arg_min(classifier, frame_id) AS classifier, arg_min(score, frame_id) AS score,
          arg_min(cached_at, frame_id) AS cached_at, 'previous' AS backend FROM (
        SELECT frame_id, content_hash,
          CASE WHEN suffix(content_hash, '0') THEN 'MAYBE' WHEN substr(content_hash, 1, 1) < '8' THEN 'DATA' ELSE 'INSTRUCTION' END AS classifier,
          CASE WHEN substr(content_hash, 1, 1) < '8' THEN {CL.DATA_SCORE}::DOUBLE ELSE {CL.INSTRUCTION_SCORE}::DOUBLE END AS score,
          TIMESTAMP '2023-12-31 00:00:00' + to_seconds((frame_id * 97) % 172800) AS cached_at
        FROM {_sql_candidates()} WHERE frame_id % 2 = 0) GROUP BY content_hash)"""


def _candidates(m):
    """The windows of the members that the gate lets through, with their hash."""
    g = CL.gate(F.col("direction"), F.col("det_score"), F.col("shape_note"), F.col("result_text"))
    m = FR.settled(m.withColumn("_gate", g), "_gate")
    c = m.where((F.col("_gate") == "candidate") & ~CL.blank(F.col("result_text"))).select(
        "frame_id", "result_text", "det_score", CL.classifier_input(F.col("result_text")).alias("w")
    )
    c = c.select("frame_id", "result_text", "det_score", F.size("w").cast("long").alias("n_windows"), F.explode("w").alias("sample"))
    return c.withColumn("content_hash", F.sha2("sample", 256))


@register(
    "classifier_input",
    lambda: f"SELECT frame_id, length(result_text) AS n_chars, n_windows, length(sample) AS sample_chars, content_hash FROM {_sql_candidates()}",
)
def q_classifier_input(spark, sf):
    _prep(spark)
    c = _candidates(_cls_members(spark, sf))
    return c.select("frame_id", F.length("result_text").cast("long").alias("n_chars"), "n_windows", F.length("sample").cast("long").alias("sample_chars"), "content_hash")


_ANSWERS = ["DATA", " instruction.", "Instr", "data-only", "INSTRUCTIONS follow", "maybe", "42 DATA", "", "Données"]


@register(
    "parse_label",
    lambda: f"""SELECT doc_id, answer, CASE WHEN upper(tok) LIKE 'INSTRUCTION%' OR upper(tok) = 'INSTR' THEN 'INSTRUCTION'
        WHEN upper(tok) LIKE 'DATA%' THEN 'DATA' END AS label
      FROM (SELECT doc_id, answer, regexp_extract(answer, '\\pL+', 0) AS tok FROM (
        SELECT doc_id, [{', '.join(P._q(a) for a in _ANSWERS)}][(doc_id % {len(_ANSWERS)}) + 1] || ' ' || text AS answer FROM documents))""",
)
def q_parse_label(spark, sf):
    """Model answers derived from documents (a fixed answer shape per doc id
    followed by the document's text) -> label."""
    _prep(spark)
    d = P.read_table(spark, sf, "documents")
    ans = F.concat(F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("doc_id") % len(_ANSWERS) + 1).cast("int")), F.lit(" "), F.col("text"))
    return d.select("doc_id", ans.alias("answer")).withColumn("label", CL.parse_label(F.col("answer")))


@register("classifier_gate", lambda: f"SELECT frame_id, pos, {_sql_gate()} AS gate FROM {_sql_cls_members()}")
def q_classifier_gate(spark, sf):
    _prep(spark)
    m = _cls_members(spark, sf)
    return m.select("frame_id", _pos(), CL.gate(F.col("direction"), F.col("det_score"), F.col("shape_note"), F.col("result_text")).alias("gate"))


_NOW_SQL = f"TIMESTAMP '{CLS_NOW}'"


@register(
    "cache_lookup",
    lambda: f"""SELECT c.frame_id, c.content_hash, p.classifier AS cached_label, p.score AS cached_score FROM {_sql_candidates()} c
      LEFT JOIN (SELECT * FROM {_sql_cache_prev()} WHERE classifier IN ('DATA', 'INSTRUCTION')
                 AND epoch_us({_NOW_SQL}) - epoch_us(cached_at) <= {CL.CACHE_TTL_S * 1_000_000}::BIGINT) p USING (content_hash)""",
)
def q_cache_lookup(spark, sf):
    _prep(spark)
    # scanned once: the candidates are looked up in a cache made of them
    c = written_once(_candidates(_cls_members(spark, sf)).select("frame_id", "content_hash"))
    looked = CL.cache_lookup(c, _cache_prev(spark, c), F.lit(CLS_NOW).cast("timestamp"))
    return looked.select("frame_id", "content_hash", "cached_label", "cached_score")


def _run_cls(spark, sf, *more):
    """Scanned once; ``more``: columns of the members that are wanted afterwards."""
    m = written_once(_cls_members(spark, sf).select("frame_id", "direction", "det_score", "shape_note", "result_text", *more))
    cache = written_once(_cache_prev(spark, _candidates(m)))
    return CL.run_classifier(m, classifier=parity_model, cache=cache, now=F.lit(CLS_NOW).cast("timestamp"), backend="parity")[:2]


def _sql_windows() -> str:
    """The candidates' windows with the cached and the model's label."""
    fresh = f"""(SELECT content_hash, classifier AS cached_label, score AS cached_score FROM {_sql_cache_prev()}
        WHERE classifier IN ('DATA', 'INSTRUCTION') AND epoch_us({_NOW_SQL}) - epoch_us(cached_at) <= {CL.CACHE_TTL_S * 1_000_000}::BIGINT)"""
    ne = "(length(sample) - length(replace(sample, 'e', '')))"
    model = f"CASE WHEN {ne} % 11 = 0 THEN NULL WHEN {ne} % 2 = 0 THEN 'DATA' ELSE 'INSTRUCTION' END"
    return f"""(SELECT frame_id, content_hash, cached_label, model_label, coalesce(cached_label, model_label) AS label,
        coalesce(cached_score, CASE model_label WHEN 'INSTRUCTION' THEN {CL.INSTRUCTION_SCORE}::DOUBLE WHEN 'DATA' THEN {CL.DATA_SCORE}::DOUBLE END) AS w_score
      FROM (SELECT c.frame_id, c.content_hash, f.cached_label, f.cached_score, CASE WHEN f.cached_label IS NULL THEN {model} END AS model_label
            FROM {_sql_candidates()} c LEFT JOIN {fresh} f USING (content_hash)))"""


def _sql_classified() -> str:
    return f"""(SELECT m.frame_id, m.pos, m.det_score AS rule_score, m.gate, w.* EXCLUDE (frame_id)
      FROM (SELECT *, {_sql_gate()} AS gate FROM {_sql_cls_members()}) m
      LEFT JOIN (
        SELECT *, CASE WHEN label = 'INSTRUCTION' THEN bad_score WHEN label = 'DATA' THEN any_score END AS classifier_score FROM (
          SELECT *, CASE WHEN bad THEN 'INSTRUCTION' WHEN n_unlabelled = 0 THEN 'DATA' END AS label FROM (
            SELECT frame_id, coalesce(bool_or(label = 'INSTRUCTION'), false) AS bad, max(w_score) FILTER (WHERE label = 'INSTRUCTION') AS bad_score,
              max(w_score) AS any_score, bool_and(cached_label IS NOT NULL) AS cached, count(*) AS n_windows,
              count(*) FILTER (WHERE label IS NULL) AS n_unlabelled
            FROM {_sql_windows()} GROUP BY frame_id))) w USING (frame_id))"""


@register(
    "classify_misses",
    lambda: f"""SELECT frame_id, CASE WHEN gate <> 'candidate' THEN gate WHEN n_windows IS NULL THEN 'skipped:empty'
          WHEN cached THEN 'cache_hit' WHEN label IS NULL THEN 'parse_error' ELSE 'ok' END AS classifier_note,
        label AS det_classifier, classifier_score
      FROM {_sql_classified()}""",
)
def q_classify_misses(spark, sf):
    """The model sees each distinct missed window once; hits come from the cache."""
    _prep(spark)
    out, _ = _run_cls(spark, sf)
    return out.select("frame_id", "classifier_note", "det_classifier", "classifier_score")


@register(
    "cache_upsert",
    lambda: f"""SELECT content_hash, arg_max(classifier, cached_at) AS classifier, arg_max(score, cached_at) AS score, max(cached_at) AS cached_at
      FROM (SELECT content_hash, classifier, score, cached_at FROM {_sql_cache_prev()}
            UNION ALL
            SELECT DISTINCT content_hash, model_label, w_score, {_NOW_SQL}
            FROM {_sql_windows()} WHERE model_label IS NOT NULL)
      GROUP BY content_hash""",
)
def q_cache_upsert(spark, sf):
    _prep(spark)
    _, cache = _run_cls(spark, sf)
    return cache.select("content_hash", "classifier", "score", "cached_at")


@register("cache_by_parts", lambda: f"SELECT content_hash, classifier, score, cached_at FROM {_sql_cache_prev()}")
def q_cache_by_parts(spark, sf):
    """The earlier run's cache kept by parts of the hash: first labels a year
    old for all of it, then the labels themselves in three batches; each batch reads and writes only its parts."""
    _prep(spark)
    path = AU.scratch_path(spark, "cache")
    prev = written_once(_cache_prev(spark, _candidates(_cls_members(spark, sf)))).select("content_hash", "classifier", "score", "cached_at", "backend")
    CL.store_labels(prev.withColumns({"classifier": F.lit("MAYBE"), "cached_at": F.col("cached_at") - F.expr("INTERVAL 365 DAYS")}), path)
    for n in range(3):
        CL.store_labels(prev.where(F.pmod(F.xxhash64("content_hash", F.lit(n)), F.lit(3)) == 0) if n < 2 else prev, path)
    return read_keyed(spark, path, CL.CACHE_SCHEMA).drop("backend")


@register(
    "combine_score",
    lambda: f"""SELECT frame_id, rule_score, classifier_score, greatest(rule_score, coalesce(classifier_score, rule_score)) AS det_score
      FROM {_sql_classified()}""",
)
def q_combine_score(spark, sf):
    _prep(spark)
    out, _ = _run_cls(spark, sf)
    return out.select("frame_id", F.col("det_score").alias("rule_score"), "classifier_score", CL.combine_score(F.col("det_score"), F.col("classifier_score")).alias("det_score"))


@register(
    "uninspected_truncated",
    lambda: f"""SELECT frame_id, n_windows, n_unlabelled FROM {_sql_classified()}
      WHERE n_windows > 1 AND label IS DISTINCT FROM 'INSTRUCTION' AND greatest(rule_score, coalesce(classifier_score, rule_score)) < 0.85""",
)
def q_uninspected_truncated(spark, sf):
    """Allowed frames longer than one classifier window: all their windows are
    classified, ``n_unlabelled`` of them without a usable answer."""
    _prep(spark)
    out, _ = _run_cls(spark, sf, "rules_hit", "member")
    score = CL.combine_score(F.col("det_score"), F.col("classifier_score"))
    d = decide(IN.DEFAULT_POLICY, direction=F.col("direction"), method=F.lit(None).cast("string"), score=score,
               classifier=F.col("det_classifier"), rules_hit=F.col("rules_hit"), raw=F.col("member"))
    return out.where((F.col("n_windows") > 1) & (d["action"] == "allow")).select("frame_id", "n_windows", "n_unlabelled")


# ================================================================ streaming
from ..streaming import stream as SS  # noqa: E402


def _run_to_end(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _write_frames(frames, path):
    """Eight files; their row groups are small, so that a micro-batch of a few files is read by all cores."""
    frames.repartition(8).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


ROW_GROUP_BYTES = 4 << 20


@register("stream_inspect", lambda: f"{SI.sql_inspect_with()} SELECT {_AUDIT_OUT} FROM a")
def q_stream_inspect(spark, sf):
    """Frames written as files, inspected as a stream (several micro-batches);
    the result equals the batch ``inspect_frames``."""
    _prep(spark)
    src = AU.scratch_path(spark, "frames-src")
    _write_frames(P.all_frames(spark, sf), src)
    audit = AU.scratch_path(spark, "stream-audit")
    q = SS.stream_inspect(
        SS.frames_stream(spark, src, max_files=3), audit, AU.scratch_path(spark, "ckpt-inspect"),
        allowed_tools=list(SI.ALLOWED_TOOLS), server_name=P.SERVER_NAME,
    )
    _run_to_end(q)
    return _audit_out(SS.read_stream_audit(spark, audit))


@register("follow", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE det_verdict = 'BLOCK'")
def q_follow(spark, sf):
    """Follow the audit table with a BLOCK filter while it grows in two
    appends; the follower's checkpoint is its cursor."""
    _prep(spark)
    audit = AU.scratch_path(spark, "follow-audit")
    a = AU.audit_like(spark, sf)
    mid = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    AU.audit_write(a.where(mid), audit)
    out, ck = AU.scratch_path(spark, "follow-out"), AU.scratch_path(spark, "ckpt-follow")
    _run_to_end(SS.copy_stream(SS.follow(spark, audit, "BLOCK"), out, ck))
    AU.audit_write(a.where(~mid), audit)
    _run_to_end(SS.copy_stream(SS.follow(spark, audit, "BLOCK"), out, ck))  # resumes after the cursor
    return _audit_cols(spark.read.parquet(out))


@register(
    "stream_verdict_counts",
    lambda: f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
        det_verdict, count(*) AS n FROM {AU.sql_audit_like()} GROUP BY ALL""",
)
def q_stream_verdict_counts(spark, sf):
    """Hourly verdict counts over the audit stream, whose files arrive in no
    particular time order."""
    _prep(spark)
    audit = AU.scratch_path(spark, "counts-audit")
    AU.audit_write(AU.audit_like(spark, sf), audit)
    out = AU.scratch_path(spark, "counts-out")
    _run_to_end(SS.write_counts(SS.follow(spark, audit, max_files=8), out, AU.scratch_path(spark, "ckpt-counts")))
    return SS.total_counts(spark, out)


@register(
    "stream_replies",
    lambda: f"{SI.sql_inspect_with()} SELECT frame_id, direction, reply_line FROM o WHERE reply_line IS NOT NULL",
)
def q_stream_replies(spark, sf):
    """The replies a stream of frames writes, in several micro-batches."""
    _prep(spark)
    src, out = AU.scratch_path(spark, "frames-src"), AU.scratch_path(spark, "stream-replies")
    _write_frames(P.all_frames(spark, sf), src)
    q = SS.stream_inspect(
        SS.frames_stream(spark, src, max_files=3), AU.scratch_path(spark, "stream-audit"), AU.scratch_path(spark, "ckpt-inspect"),
        replies_path=out, allowed_tools=list(SI.ALLOWED_TOOLS), server_name=P.SERVER_NAME,
    )
    _run_to_end(q)
    return spark.read.parquet(out).select("frame_id", "direction", "reply_line")


@register(
    "follow_seeded",
    lambda: f"""WITH a AS (SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE det_verdict = 'BLOCK'),
      seed AS (SELECT event_id FROM a WHERE ts < TIMESTAMP '2024-01-16 00:00:00' ORDER BY event_id DESC LIMIT 20)
      SELECT * FROM a WHERE event_id >= coalesce((SELECT min(event_id) FROM seed), event_id)""",
)
def q_follow_seeded(spark, sf):
    """Follow the growing log from its 20 newest BLOCK rows on."""
    _prep(spark)
    audit = AU.scratch_path(spark, "follow-audit")
    a = AU.audit_like(spark, sf)
    mid = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    AU.audit_write(a.where(mid), audit)
    start = ST.seed_cursor(AU.audit_read(spark, audit), 20, "BLOCK")
    out, ck = AU.scratch_path(spark, "follow-out"), AU.scratch_path(spark, "ckpt-follow")
    _run_to_end(SS.copy_stream(SS.follow(spark, audit, "BLOCK", start=start), out, ck))
    AU.audit_write(a.where(~mid), audit)
    _run_to_end(SS.copy_stream(SS.follow(spark, audit, "BLOCK", start=start), out, ck))
    return _audit_cols(spark.read.parquet(out))


_LATE = "event_id % 3 = 0"  # a third of the rows comes in a commit of its own, whatever its time


def _two_commits(spark, sf, between=lambda path: None):
    """The audit log in two commits, the second one late in time, and the last row of the first as a cursor."""
    path = AU.scratch_path(spark, "commits")
    a = AU.audit_like(spark, sf)
    AU.audit_commit(a.where(f"NOT ({_LATE})"), path)
    cursor = ST.seed_cursor(AU.audit_read(spark, path), 1, key=ST.ARRIVAL_KEY)
    between(path)
    AU.audit_commit(a.where(_LATE), path)
    return path, cursor


@register("page_since_arrival", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE {_LATE}")
def q_page_since_arrival(spark, sf):
    """Pages from the end of the first commit on hold the whole second one."""
    _prep(spark)
    path, cursor = _two_commits(spark, sf)
    log = AU.audit_read(spark, path)
    return _audit_cols(ST.page_since(log, cursor, log.count(), key=ST.ARRIVAL_KEY))


@register("follow_arrival", lambda: f"SELECT {_AUD} FROM {AU.sql_audit_like()} WHERE det_verdict = 'BLOCK'")
def q_follow_arrival(spark, sf):
    """A follower that has seen the first commit is shown the second too, however late its rows' times."""
    _prep(spark)
    out, ck = AU.scratch_path(spark, "follow-out"), AU.scratch_path(spark, "ckpt-follow")

    def follow(path):
        _run_to_end(SS.copy_stream(SS.follow(spark, path, "BLOCK"), out, ck))

    path, _ = _two_commits(spark, sf, follow)
    follow(path)
    return _audit_cols(spark.read.parquet(out))


# ------------------------------------------- one log: inspect, write, report
_LOG_START, _LOG_END = _dt.datetime(2000, 1, 1), _dt.datetime(2200, 1, 1)


def _inspected_log(spark, sf):
    """The frames' audit rows written to a date-partitioned log and read back."""
    path = AU.scratch_path(spark, "inspected-log")
    AU.audit_write(_inspection(spark, sf).events, path)
    return AU.audit_read(spark, path)


@register(
    "inspected_log_report",
    lambda: f"""{SI.sql_inspect_with()},
      hits AS (SELECT unnest(string_split(det_rules, ',')) AS rule_id, unnest(generate_series(0, len(string_split(det_rules, ',')) - 1)) AS p,
                 ts, session_id, direction, frame_id, pos FROM a WHERE det_rules IS NOT NULL),
      top AS (SELECT rule_id, count(*) AS n, min(row(ts, session_id, direction, frame_id, pos, p)) AS first_hit FROM hits GROUP BY rule_id
              ORDER BY n DESC, first_hit LIMIT 5)
      SELECT count(*) AS total_events, count(*) FILTER (WHERE det_verdict = 'PASS') AS n_pass,
        count(*) FILTER (WHERE det_verdict = 'WARN') AS n_warn, count(*) FILTER (WHERE det_verdict = 'BLOCK') AS n_block,
        (SELECT string_agg(rule_id || ':' || n, ',' ORDER BY n DESC, first_hit) FROM top) AS top_rules FROM a""",
)
def q_inspected_log_report(spark, sf):
    _prep(spark)
    report = ST.stats_report(_inspected_log(spark, sf), _LOG_START, _LOG_END, key=ST.FRAME_KEY)
    return report.select("total_events", "n_pass", "n_warn", "n_block", "top_rules")


@register(
    "inspected_log_tail",
    lambda: f"""{SI.sql_inspect_with()} SELECT frame_id, pos, session_id, ts, direction, kind, det_verdict, note FROM a WHERE det_verdict = 'BLOCK'
      ORDER BY ts DESC, session_id DESC, direction DESC, frame_id DESC, pos DESC LIMIT 20""",
)
def q_inspected_log_tail(spark, sf):
    """The 20 newest blocked rows of the inspected log."""
    _prep(spark)
    t = ST.tail(_inspected_log(spark, sf), 20, "BLOCK", key=ST.FRAME_KEY)
    return t.select("frame_id", _pos(), "session_id", "ts", "direction", "kind", "det_verdict", "note")
