"""Text normalisation as Spark Columns.

Three views of a text are scanned by the rule engine:

* ``raw``      - the text as stored;
* ``within``   - NFKC, cross-script look-alikes folded to Latin, invisible
                 characters deleted (catches ``I<ZWSP>gnore``);
* ``between``  - NFKC, look-alikes folded, invisible characters turned into
                 a space and whitespace runs collapsed (catches
                 ``Ignore<ZWSP>all``).

Everything is JVM-side: ``translate`` and ``regexp_replace``, and NFKC through
the ICU library Spark ships (``java_method``).  Only when ICU is missing does
NFKC fall back to an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical verdicts).
#
# Cross-script homoglyph fold, source letter -> Latin letter, in this order:
#   Cyrillic lower-case: а е о р с у х і ї ј ѕ      -> a e o p c y x i i j s
#   Cyrillic upper-case: А В Е К М Н О Р С Т У Х І Ј -> A B E K M H O P C T Y X I J
#   Greek lower-case:    α ε ι ο ρ τ υ ν χ          -> a e i o p t u v x
#   Greek upper-case:    Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ -> A B E Z H I K M N O P T Y X
#
# Invisible / formatting characters: U+00AD, U+200B-U+200F, U+202A-U+202E,
# U+2060-U+2064, U+2066-U+2069, U+FEFF, U+E0000-U+E007F.
#
# Whitespace (Python's str.isspace set, used instead of the engine-specific
# ``\s``): U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# --------------------------------------------------------------------------
HOMOGLYPH_FROM = (
    "аеорсухіїјѕ"
    "АВЕКМНОРСТУХІЈ"
    "αειορτυνχ"
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
)
HOMOGLYPH_TO = (
    "aeopcyxiijs"
    "ABEKMHOPCTYXIJ"
    "aeioptuvx"
    "ABEZHIKMNOPTYX"
)
assert len(HOMOGLYPH_FROM) == len(HOMOGLYPH_TO) == 48

# Regex character classes written in the syntax shared by Java regex and RE2
# (``\x{...}`` escapes), so the same string runs in Spark and in DuckDB.
INVISIBLE_CLASS = (
    r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}"
    r"\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
)
WS_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_WS_BUT_SPACE = WS_CLASS.replace(" ", "", 1)
_WS_ASCII = r"\t\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{1F}"  # without the space
NOT_WS = WS_CLASS.replace("[", "[^", 1)

# Letters whose Unicode case mapping lands on an ASCII letter although they
# are not ASCII themselves.  Folding them before ``lower`` makes a lower-case
# keyword probe exact for case-insensitive (Unicode-case) regexes.
CASE_ODD_FROM = "İıſK"
CASE_ODD_TO = "iisk"


@functools.lru_cache(maxsize=1)
def _stable_class() -> str:
    """Characters that NFKC leaves unchanged and that can never combine with
    a neighbour, as a regex class body, computed from ``unicodedata`` over the
    Latin, Greek and Cyrillic blocks (U+0000-U+052F) and General Punctuation
    (U+2000-U+206F).  A text made only of them is NFKC-stable."""
    import sys

    seconds = set()  # characters that can complete a canonical composition
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2:
                seconds.add(int(parts[1], 16))
    stable = [
        c
        for c in list(range(0x0000, 0x0530)) + list(range(0x2000, 0x2070))
        if unicodedata.normalize("NFKC", chr(c)) == chr(c)
        and unicodedata.combining(chr(c)) == 0
        and c not in seconds
        and not 0xD800 <= c <= 0xDFFF
    ]
    ranges, start, prev = [], stable[0], stable[0]
    for c in stable[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        ranges.append(f"\\x{{{start:X}}}-\\x{{{prev:X}}}" if prev > start else f"\\x{{{start:X}}}")
        if c is not None:
            start = prev = c
    return "".join(ranges)


def needs_nfkc(col: Column) -> Column:
    """Exact pre-test: only texts with a character outside the NFKC-stable
    set can change under NFKC."""
    return col.rlike("[^" + _stable_class() + "]")


def _nfkc_series(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x):
            return x
        return unicodedata.normalize("NFKC", x)

    return s.map(one)


nfkc_udf = F.pandas_udf(_nfkc_series, T.StringType())


_ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"


_icu: list[bool] = []  # what was found, once there was a session to ask


def icu_available() -> bool:
    """Spark bundles ICU4J (collation support); check the driver classpath."""
    from pyspark.sql import SparkSession

    if not _icu and (spark := SparkSession.getActiveSession()) is not None:
        try:
            spark._jvm.java.lang.Class.forName(_ICU_NORMALIZER)  # classic (non-Connect) sessions
            _icu.append(True)
        except Exception:  # noqa: BLE001 - no JVM handle or class missing -> Python fallback
            _icu.append(False)
    return bool(_icu) and _icu[0]


def is_ascii(col: Column) -> Column:
    """Texts of one byte a character: no Unicode form, look-alike or invisible character is in them."""
    return F.octet_length(col) == F.char_length(col)


# neither ASCII nor a letter of Latin-1; the code points below U+0100 one by one, as Java looks these up in one table
_ODD = "[" + "".join(f"\\x{{{c:X}}}" for c in [*range(0x80, 0xC0), 0xD7, 0xF7]) + r"\x{100}-\x{10FFFF}]"


def is_plain(col: Column) -> Column:
    """Texts of ASCII and Latin-1 letters only: NFKC and look-alike folding leave them as they are, they hold no
    invisible character, no white space beyond ASCII and no character without case beyond ASCII."""
    return F.when(is_ascii(col), True).otherwise(~col.rlike(_ODD))


def nfkc(col: Column, needs: Column | None = None) -> Column:
    """Unicode NFKC normalisation, JVM-side through ICU's
    ``Normalizer.compose(text, compat=true)`` via ``java_method`` for texts that are not ASCII; without ICU
    on the classpath, an Arrow-batched Python UDF for the rows that can
    change (``needs``, default ``needs_nfkc``)."""
    if icu_available():
        icu = F.call_function("java_method", F.lit(_ICU_NORMALIZER), F.lit("compose"), col, F.lit(True))
        return F.when(is_ascii(col), col).otherwise(icu)
    needs = needs if needs is not None else needs_nfkc(col)
    return F.when(needs, nfkc_udf(F.when(needs, col))).otherwise(col)


# every look-alike above lies in U+0391-U+0458 (Greek and Cyrillic blocks)
_HOMOGLYPH_RANGE = r"[\x{391}-\x{458}]"


def fold_homoglyphs(col: Column) -> Column:
    """Map the 48 Cyrillic/Greek look-alike letters to Latin, one to one
    (``translate`` runs only on texts that contain Greek or Cyrillic)."""
    return F.when(col.rlike(_HOMOGLYPH_RANGE), F.translate(col, HOMOGLYPH_FROM, HOMOGLYPH_TO)).otherwise(col)


def strip_invisible(col: Column, replacement: str = "") -> Column:
    """Delete (or replace) zero-width, bidi, BOM, soft-hyphen and TAG characters."""
    return F.regexp_replace(col, INVISIBLE_CLASS, replacement)


def collapse_whitespace(col: Column, plain: Column | None = None) -> Column:
    """Runs of white space as one space; a single space is no run to replace.  ``plain``: which texts hold no white
    space beyond ASCII (default: those of ASCII); for them the class is one table, not a chain of ranges."""
    wide = F.regexp_replace(col, f"{_WS_BUT_SPACE}{WS_CLASS}*| {WS_CLASS}+", " ")
    narrow = F.regexp_replace(col, f"[{_WS_ASCII}][ {_WS_ASCII}]*| [ {_WS_ASCII}]+", " ")
    return F.when(is_ascii(col) if plain is None else plain, narrow).otherwise(wide)


def normalise_within(nfkc_col: Column) -> Column:
    """``within`` view from an already NFKC-normalised column."""
    return strip_invisible(fold_homoglyphs(nfkc_col), "")


def normalise_between(nfkc_col: Column) -> Column:
    """``between`` view from an already NFKC-normalised column."""
    return collapse_whitespace(strip_invisible(fold_homoglyphs(nfkc_col), " "))


def probe_text(col: Column, plain: Column | None = None) -> Column:
    """Lower-cased text for literal keyword probes in front of the regexes; ``plain``: which texts hold
    none of ``CASE_ODD_FROM`` (default: those of ASCII)."""
    odd = col.contains(CASE_ODD_FROM[0])
    for ch in CASE_ODD_FROM[1:]:
        odd = odd | col.contains(ch)
    return F.lower(F.when(is_ascii(col) if plain is None else plain, col).when(odd, F.translate(col, CASE_ODD_FROM, CASE_ODD_TO)).otherwise(col))


# DuckDB spellings of the same views (used by the SQL oracle).  DuckDB has no
# NFKC; on the test tables NFKC only matters for the full-width Latin letters
# of the planted payloads, which ``translate`` maps exactly like NFKC does.
FULLWIDTH_FROM = "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(
    chr(c) for c in range(0xFF41, 0xFF5B)
)
FULLWIDTH_TO = "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(
    chr(c) for c in range(0x61, 0x7B)
)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_nfkc(expr: str) -> str:
    return f"translate({expr}, {_sql_str(FULLWIDTH_FROM)}, {_sql_str(FULLWIDTH_TO)})"


def sql_fold(expr: str) -> str:
    return f"translate({expr}, {_sql_str(HOMOGLYPH_FROM)}, {_sql_str(HOMOGLYPH_TO)})"


def sql_within(expr: str) -> str:
    return f"regexp_replace({sql_fold(sql_nfkc(expr))}, {_sql_str(INVISIBLE_CLASS)}, '', 'g')"


def sql_between(expr: str) -> str:
    inner = f"regexp_replace({sql_fold(sql_nfkc(expr))}, {_sql_str(INVISIBLE_CLASS)}, ' ', 'g')"
    return f"regexp_replace({inner}, {_sql_str(WS_CLASS + '+')}, ' ', 'g')"
