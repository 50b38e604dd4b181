"""What literals a pattern's matches must hold, read off the pattern's syntax tree.

``required(pattern)`` gives a condition on a text: a literal that must occur in
it, a tuple ``("and", ...)`` or ``("or", ...)`` of such conditions, or None
where nothing is certain.  A sequence needs what each of its parts needs, a
choice what one of its branches needs, a repetition what its body needs if it
stands at least once; neighbouring characters join to one literal.  Literals
are in lower case and hold no white space, as the scan looks for them in a
lower-cased copy of each view, of which one differs from another in white space
only.  Characters outside ASCII are not looked for one by one, as how they fold
to lower case is the regex engine's matter; where one that has no case must
stand, the condition is ``WIDE``: the text is not ASCII.
"""

from __future__ import annotations

import os
import re
import warnings
from re import _parser as syntax

Condition = str | tuple | None

WIDE = ("wide",)
# how many spellings of one stretch of characters are told apart (``https?`` has two), and characters of one bracket
SPELLINGS = 12
SHARED = 4  # characters that alternatives must begin with alike to be looked for as one
LEAST = 4  # characters that stay of a literal whose beginning is not looked for
OFTEN = "zqjxkvbywgpfmucdlhrsnioate"  # letters of European prose, the rarest first
_ESCAPED = re.compile(r"\\x\{([0-9A-Fa-f]+)\}")


def _python(pattern: str) -> str:
    """The pattern in the spelling of Python's parser: code points as characters."""
    return _ESCAPED.sub(lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(r"\z", r"\Z")


def _nested(pattern: str) -> bool:
    """Whether a bracket stands inside another, or ``&&`` there: they mean more to Java than to Python."""
    inside, i = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside and (c == "[" or pattern.startswith("&&", i)):
            return True
        elif c in "[]":
            inside = c == "["
        i += 1
    return False


def _both(kind: str, parts: list[Condition]) -> Condition:
    """One condition of several, without doubles, and without those that another implies."""
    flat: list[Condition] = []
    for p in parts:
        flat += list(p[1:]) if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and None in flat:
        return None
    kept = list(dict.fromkeys(p for p in flat if p is not None))
    words = [p for p in kept if isinstance(p, str)]
    if kind == "and":  # a literal inside another says nothing more
        kept = [p for p in kept if not (isinstance(p, str) and any(p != w and p in w for w in words))]
    else:  # of two alternatives the shorter one holds wherever the longer does
        kept = [p for p in kept if not (isinstance(p, str) and any(p != w and w in p for w in words))]
        # one look for what they all begin with costs less than one for each
        begin = os.path.commonprefix(kept) if all(isinstance(p, str) for p in kept) else ""
        kept = [begin] if len(begin) >= SHARED else kept
    if kind == "and":  # the parts that take the fewest looks first, of these the longest
        kept.sort(key=lambda p: (looks(p), -len(p) if isinstance(p, str) else 0))
    return None if not kept else kept[0] if len(kept) == 1 else (kind, *kept)


def rare_end(literal: str) -> str:
    """The literal from its rarest character on: it occurs wherever the literal does, and a text holds
    fewer places where it could begin.  ``LEAST`` characters stay, of a shorter literal all."""
    starts = range(max(1, len(literal) - LEAST + 1))
    return literal[min(starts, key=lambda i: (OFTEN.find(literal[i]), i)) :]


def looks(condition: Condition) -> int:
    """How often a text without any of the literals is looked through."""
    if not isinstance(condition, tuple) or condition == WIDE:
        return 1
    kind, *parts = condition
    return sum(map(looks, parts)) if kind == "or" else min(map(looks, parts))


def _spellings(op, arg) -> set[str] | None:
    """The few texts that an item can be, lower-cased; None if they are many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()} if arg < 128 else None
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            first, last = value if str(kind) == "RANGE" else (value, value) if str(kind) == "LITERAL" else (0, 128)
            if last > 127 or last - first >= 2 * SPELLINGS:
                return None
            out |= {chr(c).lower() for c in range(first, last + 1)}
        return out if len(out) <= SPELLINGS // 3 else None
    if name == "SUBPATTERN":
        return _texts(arg[3])
    if name == "BRANCH":
        out = set()
        for branch in arg[1]:
            texts = _texts(branch)
            if texts is None:
                return None
            out |= texts
        return out if len(out) <= SPELLINGS else None
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] + 1 >= arg[1] and arg[1] <= 2:
        body = _texts(arg[2])
        if body is None:
            return None
        out = {""} if arg[0] == 0 else set(body)
        for _ in range(arg[1] - max(arg[0], 1) + (arg[0] == 0)):
            out |= {a + b for a in out for b in body}
        return out if len(out) <= SPELLINGS else None
    if name == "AT":
        return {""}
    return None


def _texts(items) -> set[str] | None:
    texts = {""}
    for op, arg in items:
        more = _spellings(op, arg)
        if more is None or len(texts) * len(more) > SPELLINGS:
            return None
        texts = {a + b for a in texts for b in more}
    return texts


def _literal(texts: set[str]) -> Condition:
    """One of the texts must occur: of each its longest part without white space."""
    parts = [max(t.split(), key=len, default="") for t in texts]
    return None if "" in parts else _both("or", sorted(set(parts)))


def _sequence(items) -> Condition:
    found: list[Condition] = []
    run = {""}
    for op, arg in items:
        more = _spellings(op, arg)
        if more is not None and any(t and t.isspace() for t in more):
            more = None  # white space may be spelled in many ways, and views differ in it
        if more is not None and len(run) * len(more) <= SPELLINGS:
            run = {a + b for a in run for b in more}
            continue
        found.append(_literal(run))
        run = more if more is not None else {""}
        if more is None:
            found.append(_part(op, arg))
    found.append(_literal(run))
    return _both("and", found)


def _caseless(first: int, last: int) -> bool:
    """Whether a range lies outside ASCII and no character of it has another case."""
    return first > 127 and last - first < 4096 and all(chr(c).lower() == chr(c) == chr(c).upper() for c in range(first, last + 1))


def _part(op, arg) -> Condition:
    name = str(op)
    if name == "LITERAL":
        return WIDE if _caseless(arg, arg) else None
    if name == "IN":
        ranges = [v if str(k) == "RANGE" else (v, v) if str(k) == "LITERAL" else (0, 0) for k, v in arg]
        return WIDE if all(_caseless(*r) for r in ranges) else None
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "ATOMIC_GROUP":
        return _sequence(arg)
    if name == "BRANCH":
        return _both("or", [_sequence(branch) for branch in arg[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
        return _sequence(arg[2])
    return None


def required(pattern: str) -> Condition:
    """The condition on any text that the pattern matches in; None where none is known (or the syntax is not Python's too)."""
    if _nested(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _sequence(syntax.parse(_python(pattern)))
    except (re.error, OverflowError, RecursionError):
        return None


def implies(condition: Condition, probes: tuple[str, ...]) -> bool:
    """Whether the condition makes sure that one of the probes occurs."""
    if condition is None:
        return False
    if condition == WIDE:
        return False
    if isinstance(condition, str):
        return any(p in condition for p in probes)
    kind, *parts = condition
    return (any if kind == "and" else all)(implies(p, probes) for p in parts)


def holds(condition: Condition, text: str) -> bool:
    """The condition on a lower-cased text, outside Spark (for tests and linting)."""
    if condition is None:
        return True
    if condition == WIDE:
        return not text.isascii()
    if isinstance(condition, str):
        return condition in text
    kind, *parts = condition
    return (all if kind == "and" else any)(holds(p, text) for p in parts)
