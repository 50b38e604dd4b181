"""Chat formatting: minimum-cost repair of roles, then rendering.

A conversation is legal if at most one system turn opens it, user and assistant
turns alternate from a user turn on, and it ends with an assistant turn.  Each
turn may keep its role, be relabelled, or be merged into the turn before it;
an empty turn may be inserted before any turn or at the end.  Every choice has
a cost, and dynamic programming over the automaton of legal turns finds the
sequence of choices with the least total.

The automaton's state is the role of the last turn written (``start`` before
any).  A turn is a table of costs from state to state, tables of consecutive
turns multiply (least sum), and the product is associative, so a conversation
is cut into chunks of at most ``chunk`` turns: each chunk's table is computed
by a task of its own, the tables of a conversation (one small row a chunk) give
the states where chunks meet, and each chunk is then traced back and rendered
apart.  One call holds about 256 chunks, however many turns a conversation has.
A conversation of up to ``chunk`` turns is rendered as one row; longer ones
as one row a chunk, whose ``rendered`` join to the whole in order of ``part``.

Turns are in order of ``turn`` (nulls last), then role and text.

Edge cases: null or unknown roles have no role to keep and cost a relabel
whatever they become; a null text counts as empty; a null conv_id is a
conversation of its own; rows that repeat a turn are turns each; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, range_rank, session

ROLES = ("system", "user", "assistant")
START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}  # which role may follow; only an assistant turn may end
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MISSING = {0: [1, 2], 1: [2], 2: [], START: [1, 2]}  # turns to add at the end
BEGIN, END = "<|{}|>\n", "\n<|end|>\n"


@dataclass(frozen=True)
class Costs:
    relabel: float = 2.0
    relabel_system: float = 3.0
    merge: float = 1.0
    merge_other: float = 2.5  # into a turn of another role
    insert: float = 1.5


def _role(name: str | None) -> int:
    """Index of a role as given, -1 if it is none."""
    r = (name or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else -1


def _choices(given: int, costs: Costs) -> list[tuple[int, int, float, tuple[int, ...]]]:
    """(state before, state after, cost, empty turns inserted first); a turn that leaves its state as it is was merged."""
    out = []
    for before in range(4):
        if before != START:
            out.append((before, before, costs.merge if given in (before, -1) else costs.merge_other, ()))
        for inserted in ((), *((r,) for r in NEXT[before] if r)):
            state = inserted[0] if inserted else before
            for after in NEXT[state]:
                if after == given:
                    change = 0.0
                else:
                    change = costs.relabel_system if 0 in (after, given) else costs.relabel
                out.append((before, after, change + costs.insert * len(inserted), inserted))
    return out


def _moves(given: int, costs: Costs) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...] | None]]:
    """A turn's cost table, and what its cheapest choice does: None merges, else the empty turns inserted before."""
    table = np.full((4, 4), np.inf)
    how: dict[tuple[int, int], tuple[int, ...] | None] = {}
    for before, after, cost, inserted in _choices(given, costs):
        if cost < table[before, after]:
            table[before, after] = cost
            how[before, after] = None if before == after else inserted
    return table, how


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def _trace(tables: list[np.ndarray], first: int, last: int) -> list[int]:
    """States before, between and after the tables, along a cheapest way from ``first`` to ``last``; ties go to the lowest state."""
    cost = [np.where(np.arange(4) == first, 0.0, np.inf)]
    for t in tables:
        cost.append((cost[-1][:, None] + t).min(axis=0))
    states = [last]
    for t, c in zip(reversed(tables), reversed(cost[:-1]), strict=True):
        states.append(int((c + t[:, states[-1]]).argmin()))
    return states[::-1]


def _ending(costs: Costs) -> np.ndarray:
    """Cost of ending in each state: that of the empty turns still missing."""
    return np.array([costs.insert * len(MISSING[s]) for s in range(4)])


def _render(roles: list[int], texts: list[str], opened: bool) -> str:
    """``roles``: of each text, -1 where it joins the turn before; ``opened``: a turn is open already."""
    out = []
    for r, t in zip(roles, texts, strict=True):
        if r < 0:
            out.append(f"\n{t}" if t else "")
        else:
            out += [END if opened else "", BEGIN.format(ROLES[r]), t]
            opened = True
    return "".join(out)


def _runs(pdf: pd.DataFrame, *keys: str) -> Iterator[pd.DataFrame]:
    """The groups of a sorted frame whose ``keys`` are equal."""
    if len(pdf):
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        for i, j in itertools.pairwise(cuts):
            yield pdf.iloc[i:j]


def _by_hash(df: DataFrame, n: int, *keys: str):
    """Groups of about 256 of the ``n`` different keys, to be worked on by one call each."""
    return df.withColumn("_lot", F.pmod(F.xxhash64(*keys), F.lit(max(1, n // 256)))).groupBy("_lot")


def repair_chats(turns: DataFrame, costs: Costs | None = None, chunk: int = 512) -> DataFrame:
    """One row a chunk of a conversation: conv_id, part, counts of the repairs in it, and its rendered text.

    ``cost`` is the least total of the whole conversation, the same in all its parts.
    """
    costs = costs or Costs()
    session(turns)
    moves = {g: _moves(g, costs) for g in (-1, 0, 1, 2)}
    t = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("no_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # ranks over the whole table, in order; a conversation's own ranks begin at its least
    ranked = materialise(range_rank(t, ["no_id", "conv", "turn", "role", "text"], "at").drop("turn"))
    starts = materialise(ranked.groupBy("conv", "no_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("all")))
    n_convs, n_chunks = starts.agg(F.count(F.lit(1)), F.sum(F.ceil(F.col("all") / chunk))).first()
    chunks = ranked.join(starts, ["conv", "no_id"]).withColumn("part", F.floor((F.col("at") - F.col("first")) / chunk)).drop("first")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for g in _runs(pdf.sort_values(["conv", "no_id", "part", "at"]), "conv", "no_id", "part"):
            total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
            for r in g["role"].tolist():
                total = _times(total, moves[_role(r)][0])
            rows.append((g["conv"].iat[0], g["no_id"].iat[0], g["part"].iat[0], total.ravel().tolist()))
        return pd.DataFrame(rows, columns=["conv", "no_id", "part", "costs"])

    tables = _by_hash(chunks.drop("text", "all"), n_chunks or 0, "conv", "no_id", "part").applyInPandas(product, "conv long, no_id boolean, part long, costs array<double>")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _runs(pdf.sort_values(["conv", "no_id", "part"]), "conv", "no_id"):
            each = [np.array(c, np.float64).reshape(4, 4) for c in g["costs"]]
            way = np.where(np.arange(4) == START, 0.0, np.inf)
            for c in each:
                way = (way[:, None] + c).min(axis=0)
            total = way + _ending(costs)
            states = _trace(each, START, int(total.argmin()))
            out += zip(g["conv"], g["no_id"], g["part"], states[:-1], states[1:], [float(total.min())] * len(g), strict=True)
        return pd.DataFrame(out, columns=["conv", "no_id", "part", "before", "after", "cost"])

    meets = _by_hash(tables, n_convs or 0, "conv", "no_id").applyInPandas(meet, "conv long, no_id boolean, part long, before int, after int, cost double")
    traced = chunks.join(meets, ["conv", "no_id", "part"]).withColumn("last", F.floor((F.col("all") - 1) / chunk) == F.col("part")).drop("all")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for g in _runs(pdf.sort_values(["conv", "no_id", "part", "at"]), "conv", "no_id", "part"):
            given = [_role(r) for r in g["role"].tolist()]
            states = _trace([moves[r][0] for r in given], int(g["before"].iat[0]), int(g["after"].iat[0]))
            roles: list[int] = []
            texts: list[str] = []
            merged = relabelled = inserted = 0
            for r, text, before, after in zip(given, g["text"].tolist(), states[:-1], states[1:], strict=True):
                empty = moves[r][1][before, after]
                if empty is None:
                    merged += 1
                    roles.append(-1)
                else:
                    inserted += len(empty)
                    relabelled += after != r
                    roles += [*empty, after]
                    texts += [""] * len(empty)
                texts.append(text)
            last = bool(g["last"].iat[0])
            extra = MISSING[states[-1]] if last else []
            rendered = _render([*roles, *extra], [*texts, *[""] * len(extra)], states[0] != START) + (END if last else "")
            rows.append((g["conv"].iat[0], g["no_id"].iat[0], g["part"].iat[0], len(given), g["cost"].iat[0], merged, relabelled, inserted + len(extra), rendered))
        return pd.DataFrame(rows, columns=["conv", "no_id", "part", "n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "rendered"])

    schema = "conv long, no_id boolean, part long, n_turns long, cost double, n_merged long, n_relabelled long, n_inserted long, rendered string"
    done = _by_hash(traced, n_chunks or 0, "conv", "no_id", "part").applyInPandas(trace, schema)
    return done.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *[c for c in done.columns if c not in ("conv", "no_id")])
