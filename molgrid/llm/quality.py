"""Line-first quality rules, DataFrame functions only.

Each line of a text is judged by itself: it must end like a sentence, and must be neither navigation, nor symbols,
nor shouting, nor boilerplate, nor an earlier line again. Lines that fail are removed; a text that loses too much of
its words that way is rejected, and so is one that fails the base checks. All of it is one projection of each row:
no shuffle, no Python. Repeated 5-word windows are found by comparing sorted 64-bit window hashes of the one text.

Defined cases: a null or empty text has no words, fails the base checks and is not kept; lines without a word count
for nothing; rows that repeat are judged alike; ids may be null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of words, symbols, and what single lines are judged by.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?\x{2026}\x{3002}][\"')\]\x{201D}\x{00BB}]*[\x20\x09-\x0D]*$"
NAVIGATION = r" [|>\x{00BB}\x{00B7}\x{2022}] "
SHOUTING = r"(\p{Lu}{2,}[^\p{L}]+){5}"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|cookie policy|terms of (use|service)|accept cookies|lorem ipsum"
    r"|enable javascript|click here|subscribe to our|sign up for|log in to|share this|read more|back to top)"
)

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
MOST_LOST_PERCENT = 30


def line_passes(line: Column) -> Column:
    """Whether a line stays, on its own."""
    symbols = F.char_length(line) - F.char_length(F.translate(line, SYMBOLS, ""))
    return (
        line.rlike(SENTENCE_END)
        & (F.regexp_count(line, F.lit(NAVIGATION)) < 2)
        & (symbols * 10 <= F.char_length(line))
        & ~line.rlike(SHOUTING)
        & ~line.rlike(BOILERPLATE)
    )


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _repeat_words(starts: Column) -> Column:
    """Words inside any of the windows that begin at the sorted `starts`."""
    done = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")
        ),
    )
    return done["n"]


def judged(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with the base figures, base_failed, clean_text (lines that pass) and kept."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = texts.select(
        "*",
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    unique = lines.select("*", F.array_distinct("lines").alias("distinct_lines"), F.size("hashes").cast("long").alias("n_words"))
    starts = F.when(F.col("n_words") < WINDOW, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(1)))
    )
    windows = unique.select(
        "doc_id",
        "text",
        "n_words",
        (F.size("lines") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        F.array_join(F.filter("distinct_lines", line_passes), "\n").alias("clean_text"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))).alias("windows"),
    )
    # only texts in which some window repeats are sorted
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
    order = windows.select(
        "*", F.when(again, F.sort_array(placed)).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>")).alias("order")
    ).drop("windows")
    n = F.greatest(F.size("order") - 1, F.lit(0))
    twins = F.zip_with(
        F.slice("order", F.lit(1), n),
        F.slice("order", F.lit(2), n),
        lambda a, b: F.when(a["hash"] == b["hash"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
    )
    figures = order.select(
        "doc_id",
        "text",
        "clean_text",
        "n_words",
        "n_dup_lines",
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _repeat_words(F.sort_array(F.array_distinct(F.flatten(twins)))).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    lost = F.col("n_words") - _count_words(F.col("clean_text"))
    return figures.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (100 * lost <= MOST_LOST_PERCENT * F.col("n_words"))
    )


def report(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, text of what is kept: the lines that pass."""
    return judged(docs).where("kept").select("doc_id", F.col("clean_text").alias("text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT r, n, line, row_number() OVER (PARTITION BY r, line ORDER BY n) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT r, count(*) FILTER (nth > 1) AS n_dup_lines,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) FILTER (
           nth = 1
           AND regexp_matches(line, '[.!?\x{2026}\x{3002}]["'')\]\x{201D}\x{00BB}]*[\x20\x09-\x0D]*$')
           AND len(regexp_extract_all(line, ' [|>\x{00BB}\x{00B7}\x{2022}] ')) < 2
           AND (length(line) - length(translate(line, '#*$%&|<>', ''))) * 10 <= length(line)
           AND NOT regexp_matches(line, '(\p{Lu}{2,}[^\p{L}]+){5}')
           AND NOT regexp_matches(line, '(?i)(all rights reserved|privacy policy|cookie policy|terms of (use|service)|accept cookies|lorem ipsum|enable javascript|click here|subscribe to our|sign up for|log in to|share this|read more|back to top)')
         ) AS clean_words
  FROM lines GROUP BY r),
windows AS (
  SELECT r, s, count(*) OVER (PARTITION BY r, g) AS times
  FROM (SELECT r, s, list_slice(w, s, s + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5))),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM windows WHERE times > 1) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(clean_words, 0) AS clean_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - clean_words) <= 30 * n_words AS kept
FROM b
"""
