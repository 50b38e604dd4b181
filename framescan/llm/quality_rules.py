"""Quality rules, line first, with DataFrame functions only.

Each line is judged by three rules and the lines that fail are removed:

* punctuation: too many symbols and exclamation marks for its words, or an
  ellipsis where the line was cut off;
* navigation: separators between most of its words, or a short line made of
  menu words only;
* boilerplate: a phrase of the fixed list.

A document is rejected if the removed lines hold more than ``max_lost`` percent
of its word characters, or if a whole-document rule fails: fewer than
``min_words`` words, or more than ``max_repeat`` percent of its words in 5-word
windows that occur twice or more.

Windows are compared by 64-bit hash within one text.  Everything happens within
the row; nothing is shuffled.

Edge cases: a null text has no words and counts as empty; an empty text fails
(no words); lines without a word are neither judged nor counted; rows that
repeat are judged each; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words_of

MIN_WORDS = 10
MAX_REPEAT = 20
MAX_LOST = 50
WINDOW = 5

SYMBOLS = "[#*$%&|<>]"
MARKS = "[#*$%&<>!{}=~^]"
SEPARATORS = "[|»•›>]"
CUT_OFF = "(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"
# what a line of menu words is made of; longer words before those they begin with, so that no word is tried twice
MENU_WORDS = "home|menu|login|log in|sign in|sign up|register|search|next|previous|back|contact|about us|about|help|faq|share|print|read more|top"
MENU = f"(?i)^\\W*+(?:(?:{MENU_WORDS})\\W*+)++$"
MENU_SQL = f"(?i)^\\W*(?:(?:{MENU_WORDS})\\W*)+$"
BOILERPLATE = (
    "(?i)all rights reserved|copyright \\(c\\)|terms of (use|service)|privacy policy|cookie policy|uses cookies"
    "|subscribe to our|sign up for our newsletter|enable javascript|lorem ipsum|powered by"
)


def _count(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, chars, ""))


def _size(line: Column) -> Column:
    return F.size(words_of(line))


def _word_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(s, SPACES, ""))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails one of the rules."""
    marked = line.rlike(MARKS) & (_count(line, MARKS) * 10 > _size(line) * 3)
    separated = line.rlike(SEPARATORS) & (_count(line, SEPARATORS) * 10 > _size(line) * 2)
    return line.rlike(CUT_OFF) | marked | separated | line.rlike(MENU) | line.rlike(BOILERPLATE)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_lost: int = MAX_LOST) -> DataFrame:
    """``row`` (the document as a struct), the counts, ``base_failed``, ``kept`` and ``cleaned`` (the lines that pass)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of("text").alias("t"))
    has_word = lambda s: s.rlike("[^\\x20\\x09-\\x0D]")
    split = rows.select("row", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), has_word).alias("lines"))
    window = lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(WINDOW)])
    hashed = split.select(
        "row",
        "t",
        "lines",
        F.size("w").alias("n"),
        F.when(F.size("w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), window)).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    # positions are sorted by hash only where some hash occurs twice
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_ = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:long,i:int>>")
    by_hash = hashed.select("row", "t", "lines", "n", F.when(repeats, sorted_).otherwise(nothing).alias("s"))
    at = lambda j: F.get("s", j)["h"]
    twice = F.filter("s", lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
    placed = by_hash.select("row", "t", "lines", "n", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    # each window covers five words, less what the one before covers already
    covers = F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(x - F.get("p", j - 1), F.lit(WINDOW))))
    counted = placed.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        _word_chars(F.col("t")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda s: ~line_fails(s)).alias("good"),
        F.size("lines").alias("n_lines"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (
        counted.withColumn("cleaned", F.array_join("good", "\n"))
        .withColumn("lost_chars", F.col("word_chars") - _word_chars(F.col("cleaned")))
        .select(
            "row",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            base.alias("base_failed"),
            (~base & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
            (F.col("n_lines") - F.size("good")).cast("long").alias("n_removed_lines"),
            F.col("lost_chars").cast("long").alias("lost_chars"),
            "cleaned",
        )
    )


def quality_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """One row a document: doc_id, the counts and the verdicts."""
    return judge(docs.select("doc_id", "text"), **limits).select("row.doc_id", "*").drop("row", "cleaned")


def clean(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents that are kept, their failed lines removed."""
    good = judge(docs, **limits).where("kept")
    return good.select(*[(F.col("cleaned") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql() -> str:
    """DuckDB SQL for the query."""
    sp = SPACES
    m, sep = _sql_text(MARKS), _sql_text(SEPARATORS)
    n = f"len(list_filter(string_split_regex(l, '{sp}'), lambda x: x <> ''))"
    count = lambda chars: f"(length(l) - length(regexp_replace(l, '{chars}', '', 'g')))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS (
  SELECT *, list_filter(string_split_regex(t, '{sp}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
win AS (
  SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS o(k) GROUP BY r),
judged AS (
  SELECT r, l,
    regexp_matches(l, '{CUT_OFF}')
    OR {count(m)} * 10 > {n} * 3 OR {count(sep)} * 10 > {n} * 2
    OR regexp_matches(l, '{_sql_text(MENU_SQL)}') OR regexp_matches(l, '{_sql_text(BOILERPLATE)}') AS bad
  FROM (SELECT r, unnest(lines) AS l FROM s)),
lost AS (
  SELECT r, sum(length(regexp_replace(l, '{sp}', '', 'g'))) AS chars, count(*) AS n FROM judged WHERE bad GROUP BY r),
c AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{sp}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(lost.chars, 0) AS BIGINT) AS lost_chars
  FROM s LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept
FROM c"""
