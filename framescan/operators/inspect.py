"""The full inspection pipeline: frames -> audit rows (+ replies).

    frames_source -> oversize split -> split_batch -> parse -> tool name
      -> allowlist -> rule scan -> [classifier stage] -> policy -> verdict
      -> block reply / downgrade -> batch abort -> synthetic rows

Per-member work is one narrow stage.  Every line has a key of its own from the
source on, whatever its ids, and its members stay next to each other in their
partition, so they are gathered into one row a frame without a shuffle (an
array of structs), decided there by ``exists`` / ``filter`` / ``transform``, and
exploded last.  Only a join on the way (a classifier's answers, an allowlist
given as a DataFrame) moves members; they are then brought together by the
line's key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import check_conf, written_once
from . import classify as CL
from . import frames as FR
from . import replies as RP
from .policy import DEFAULT_POLICY, Policy, decide, verdict
from .rules import C2S, S2C, Rule
from .scan import hits_array, rule_scan, spread


LINE_KEY = "_fs_row"  # one for each source line


@dataclass
class Inspection:
    events: DataFrame  # audit rows (one per member, + synthetic rows, + oversize rows)
    replies: DataFrame  # frame_id, direction, reply_line for frames that are answered/replaced
    cache: DataFrame | None = None  # classifier cache after this run
    members: DataFrame | None = None  # per-member inspection
    outcomes: DataFrame | None = None
    learnt: DataFrame | None = None  # the cache rows that this run adds


def capability_flag(members: DataFrame, allowed_tools: Sequence[str] | DataFrame | None) -> DataFrame:
    """``cap_blocked``: a client->server ``tools/call`` whose ``tool`` is not
    on the allowlist (exact match).  No allowlist = fail-open.  A sequence is
    looked up as a set in the row; a DataFrame allowlist is joined (a left join on
    the tool name; the optimiser broadcasts it only when its size allows)."""
    if allowed_tools is None or (not isinstance(allowed_tools, DataFrame) and len(allowed_tools) == 0):
        return members.withColumn("cap_reason", F.lit("no_allowlist")).withColumn("cap_blocked", F.lit(False))
    candidate = (F.col("direction") == C2S) & F.col("tool").isNotNull()
    if isinstance(allowed_tools, DataFrame):
        allow = allowed_tools.select(F.col(allowed_tools.columns[0]).alias("_fs_allowed")).distinct()
        members = members.join(allow, F.col("tool") == F.col("_fs_allowed"), "left")
        listed = F.col("_fs_allowed").isNotNull()
    else:
        listed = F.col("tool").isin(*allowed_tools)
    out = members.withColumn(
        "cap_reason", F.when(candidate, F.when(listed, "in_allowlist").otherwise("not_in_allowlist"))
    ).withColumn("cap_blocked", F.coalesce(candidate & ~listed, F.lit(False)))
    return out.drop("_fs_allowed") if "_fs_allowed" in out.columns else out


def inspect_members(
    frames: DataFrame,
    *,
    policy: Policy = DEFAULT_POLICY,
    rules: Sequence[Rule] | None = None,
    allowed_tools: Sequence[str] | DataFrame | None = None,
    server_name: str = "",
    classifier: CL.Classifier | None = None,
    cache: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    now: Column | None = None,
    line_limit: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-member inspection (narrow).  Returns ``(members, learnt, cache)``:
    ``learnt`` holds the cache rows of what the model was asked.

    ``frames``: ``frame_id, session_id, ts, direction, raw``."""
    # Lines of any length are inspected.  Only where the caller sets a limit
    # are longer ones logged as kind 'raw', 'line_limit_exceeded', unread.
    check_conf(frames.sparkSession)
    src = spread(FR.oversize_flag(FR.frames_source(frames), line_limit).withColumn(LINE_KEY, F.monotonically_increasing_id()))
    big = F.col("oversize")
    m = FR.split_batch(src.withColumn("_fs_split", F.when(~big, F.col("raw"))), raw_col="_fs_split")
    m = m.withColumn("member", F.when(big, F.col("raw")).otherwise(F.col("member"))).drop("_fs_split")
    m = m.withColumn("_fs_pm", F.when(big, F.lit("")).otherwise(F.col("member")))
    m = FR.parse_frame(m, line_col="_fs_pm")
    m = FR.tool_name(m, server_name)
    if classifier is not None:  # the content-block walk only feeds the classifier gate
        m = FR.tool_result_text(m)
    else:
        m = m.withColumn("shape_note", F.lit(None).cast("string")).withColumn("result_text", F.lit(None).cast("string"))
    m = capability_flag(m, allowed_tools)
    m = rule_scan(m, "_fs_pm", F.col("direction"), rules)
    now = now if now is not None else F.current_timestamp()
    m, new_cache, learnt = CL.run_classifier(m, classifier=classifier, cache=cache, now=now)
    score = CL.combine_score(F.col("det_score"), F.col("classifier_score"))
    m = m.withColumn("det_score", score)
    method_hint = F.when(F.col("kind").isin("request", "notification"), F.col("method"))
    d = decide(
        policy,
        direction=F.col("direction"),
        method=method_hint,
        score=F.col("det_score"),
        classifier=F.col("det_classifier"),
        rules_hit=F.col("rules_hit"),
        raw=F.col("member"),
    )
    m = m.withColumn("_fs_d", d)
    id_json = F.to_json(F.try_variant_get(F.col("_fs_v"), "$.id", "variant"))
    trace = RP.trace_id(F.col("frame_id"), F.col("pos"))
    is_block = F.col("_fs_d.action") == "block"
    reply = RP.block_reply(
        F.col("direction"), F.col("kind"), id_json, F.coalesce(F.col("_fs_d.message"), F.lit("content judged unsafe")), trace
    )
    m = m.withColumn("id_json", id_json).withColumn("reply", F.when(is_block, reply))
    downgraded = is_block & F.col("reply").isNull()
    cnote = F.when(F.col("classifier_note") != "ok", F.col("classifier_note"))
    det_action = F.when(downgraded, "warn").otherwise(F.col("_fs_d.action"))
    m = m.withColumns({
        "det_action": det_action,
        "det_verdict": verdict(det_action),
        "matched_policy": F.col("_fs_d.matched_rule"),
        "policy_action": F.col("_fs_d.action"),
        "policy_message": F.col("_fs_d.message"),
        "note": F.when(downgraded, "downgraded:no_replacement")
        .when(is_block, F.coalesce(cnote, F.concat(F.lit("trace="), trace)))
        .otherwise(cnote),
        "is_block": is_block & ~downgraded,
    }).drop("_fs_d")
    # capability replies / rows
    cap_trace = RP.trace_id(F.col("frame_id"), F.lit("cap"))
    args = FR.arguments_json(m)
    m = m.withColumns({
        "cap_reply": F.when(F.col("cap_blocked"), RP.capability_reply(F.col("id_json"), F.col("tool"))),
        "cap_args": F.when(F.col("cap_blocked"), args),
        "cap_note": F.when(F.col("cap_blocked"), F.concat(F.lit("blocked_by_capability tool="), F.col("tool"), F.lit(" trace="), cap_trace)),
        "aborted_reply": RP.aborted_reply(F.col("kind"), F.col("id_json")),
    })
    return m, learnt, new_cache


_DET = ["det_verdict", "det_score", "rules_hit", "det_classifier", "det_action", "note"]


def gather_members(members: DataFrame) -> DataFrame:
    """One row a frame: ``m``, its members as an array of structs in order.

    A single frame is an array of its own; members of a batch frame stand next
    to each other, so each run of rows of one line becomes one array, with no
    shuffle and no more held than a line."""
    struct = F.struct("pos", *[c for c in MEMBER_COLUMNS if c != "pos"])
    kind = f"{LINE_KEY} long, m array<{members.select(struct.alias('m')).schema['m'].dataType.simpleString()}>"

    def arrays(rows: list[pa.RecordBatch], cuts: list[int]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), t["m"].chunk(0))
        return pa.RecordBatch.from_arrays([t[LINE_KEY].chunk(0).take(pa.array(cuts[:-1])), lists], [LINE_KEY, "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the line that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(key)) + 1
            before = sum(r.num_rows for r in held)
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                starts = np.concatenate([[0], starts])
            if not len(starts):
                held.append(b)
                continue
            last = int(starts[-1])
            whole = [*held, b.slice(0, last)] if last else held
            cuts = [before + int(i) for i in starts]
            yield arrays(whole, cuts if cuts[0] == 0 else [0, *cuts])
            held = [b.slice(last)]
        if held:
            yield arrays(held, [0, sum(r.num_rows for r in held)])

    single = members.where(F.col("n_members") <= 1).select(LINE_KEY, F.array(struct).alias("m"))
    batch = members.where(F.col("n_members") > 1).select(LINE_KEY, struct.alias("m")).mapInArrow(run, kind)
    return single.unionByName(batch)


def _first_block(m: Column) -> Column:
    """Position of a frame's first member that the detector blocked."""
    return F.array_min(F.transform(F.filter(m, lambda x: x["is_block"]), lambda x: x["pos"]))


def frame_outcomes(framed: DataFrame) -> DataFrame:
    """Per frame: ``frame_cap`` (some member capability-blocked),
    ``first_block`` (position of the first blocked member with a reply),
    the blocking member's det columns and the reply line for the frame."""
    m = F.col("m")
    one = F.element_at(m, 1)
    first = _first_block(m)
    cap = F.exists(m, lambda x: x["cap_blocked"])
    blocking = F.element_at(F.filter(m, lambda x: x["is_block"]), 1)

    def line(part) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(m, part), ","), F.lit("]"))

    line_cap = line(lambda x: F.when(x["cap_blocked"], x["cap_reply"]).otherwise(x["aborted_reply"]))
    line_det = line(lambda x: F.when(x["is_block"], x["reply"]).when(x["direction"] == S2C, x["member"]).otherwise(x["aborted_reply"]))
    single = F.when(one["cap_blocked"], one["cap_reply"]).when(one["is_block"], one["reply"])
    batch = F.when(cap, line_cap).when(first.isNotNull(), line_det)
    return framed.select(
        *[one[c].alias(c) for c in ("frame_id", "direction", "session_id", "ts")],
        cap.alias("frame_cap"),
        first.alias("first_block"),
        F.when(first.isNotNull(), F.struct(*[blocking[c].alias(c) for c in ("reply", *_DET)])).alias("blocking"),
        F.when(F.size(m) > 1, batch).otherwise(single).alias("reply_line"),
    )


AUDIT_COLUMNS = [
    "frame_id", "pos", "session_id", "ts", "direction", "kind", "msg_id", "method", "params_json",
    "result_json", "error_json", "raw", "note", "det_verdict", "det_score", "det_rules", "det_classifier",
    "det_latency_ms", "det_action",
]


def audit_rows(framed: DataFrame) -> DataFrame:
    """One audit row per member, and after the first member that the detector
    blocked in a client->server frame one synthetic server->client row."""
    m, none = F.col("m"), F.lit(None).cast("string")
    # what the frame decides for all its members, once
    framed = framed.select("m", F.exists(m, lambda x: x["cap_blocked"]).alias("_fcap"), _first_block(m).alias("_first"))
    fcap = F.col("_fcap")

    def own(x: Column) -> dict[str, Column]:
        cap, inspected = x["cap_blocked"], ~fcap & ~x["oversize"]
        return {
            "frame_id": x["frame_id"],
            "pos": x["pos"].cast("int"),
            "session_id": x["session_id"],
            "ts": x["ts"],
            "direction": x["direction"],
            "kind": FR.event_kind(x["kind"]),
            "msg_id": x["msg_id"],
            "method": x["method"],
            "params_json": F.when(cap, x["cap_args"]).otherwise(x["params_json"]),
            "result_json": F.when(~cap, x["result_json"]),
            "error_json": F.when(~cap, x["error_json"]),
            "raw": x["member"],
            "note": F.when(cap, x["cap_note"]).when(x["oversize"], F.lit("line_limit_exceeded")).when(inspected, x["note"]),
            "det_verdict": F.when(cap, "BLOCK").when(inspected, x["det_verdict"]),
            "det_score": F.when(inspected, x["det_score"]),
            "det_rules": F.when(inspected, hits_array(x["rules_hit"])),
            "det_classifier": F.when(inspected, x["det_classifier"]),
            "det_latency_ms": F.lit(None).cast("int"),
            "det_action": F.when(cap, "block").when(inspected, x["det_action"]),
        }

    def answer(x: Column) -> dict[str, Column]:
        # the reply is an error message written by us: its error object follows the id
        at = F.length(x["id_json"]) + len('{"jsonrpc":"2.0","id":,"error":') + 1
        return own(x) | {
            "pos": F.lit(-1),
            "direction": F.lit(S2C),
            "kind": F.lit("error"),
            "method": none,
            "params_json": none,
            "result_json": none,
            "error_json": F.substring(x["reply"], at, F.length(x["reply"]) - at),
            "raw": x["reply"],
            "note": F.lit("synthetic-block"),
            "det_verdict": x["det_verdict"],
            "det_score": x["det_score"],
            "det_rules": hits_array(x["rules_hit"]),
            "det_classifier": x["det_classifier"],
            "det_action": x["det_action"],
        }

    def row(cols: dict[str, Column]) -> Column:
        return F.struct(*[cols[c].alias(c) for c in AUDIT_COLUMNS])

    answered = F.filter(m, lambda x: (x["direction"] == C2S) & x["is_block"] & (x["pos"] == F.col("_first")))
    answers = F.when(~fcap, F.transform(answered, lambda x: row(answer(x)))).otherwise(F.array())
    return framed.select(F.inline(F.concat(F.transform(m, lambda x: row(own(x))), answers)))


MEMBER_COLUMNS = [
    "frame_id", "pos", "session_id", "ts", "direction", "n_members", "is_batch", "oversize", "member", "kind", "msg_id",
    "method", "params_json", "result_json", "error_json", "tool", "cap_blocked", "cap_reason", "cap_reply",
    "cap_args", "cap_note", "aborted_reply", "id_json", "rules_hit", "det_score", "det_classifier",
    "classifier_note", "det_action", "det_verdict", "matched_policy", "policy_action", "policy_message", "note",
    "reply", "is_block",
]


def inspect_frames(frames: DataFrame, *, once: bool = True, **kwargs) -> Inspection:
    """Run the pipeline.  ``events`` and ``replies`` are plans of their own: an
    action on one runs the scan and keeps nothing.  ``once`` (the default)
    writes the members to the shared checkpoint folder first, so that reading
    several results, or filtering by what the scan found, does not repeat the
    rules; without it the events are one narrow pass."""
    members, learnt, cache = inspect_members(frames, **kwargs)
    members = members.select(LINE_KEY, *MEMBER_COLUMNS)
    if kwargs.get("classifier") is not None or kwargs.get("cache") is not None or isinstance(kwargs.get("allowed_tools"), DataFrame):
        # a join may have moved them
        members = members.repartition(LINE_KEY).sortWithinPartitions(LINE_KEY, "pos")
    if once:
        members = written_once(members)
    framed = gather_members(members)
    outcomes = frame_outcomes(framed)
    replies = outcomes.where(F.col("reply_line").isNotNull()).select("frame_id", "session_id", "direction", "reply_line")
    return Inspection(events=audit_rows(framed), replies=replies, cache=cache, members=members.drop(LINE_KEY), outcomes=outcomes, learnt=learnt)
