"""Line-first cleaning: rules per line, failing lines are removed, documents that lose too much are rejected.

Only DataFrame functions.  A text stays in its row from scan to result: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Base rules: fewest words; highest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 30
#: A document that loses more than this percentage of its words with its lines is rejected.
MAX_LOST = 50
#: Words below which a line counts as a fragment if it has no end mark; from which repetition is judged.
FRAGMENT, JUDGED = 4, 8

# Marks that end a sentence, and wordings of notices that sites add to their pages.
END_MARK = r"[.!?…:;\"'”’»)\]]\s*$"
NOTICE = (
    r"(?i)^\W*(all rights reserved|licensed under\b|released under\b|this work is licensed\b|copyright\b|©"
    r"|powered by\b|terms of (use|service)\b|privacy policy\b|cookie (policy|settings)\b|accept (all )?cookies\b"
    r"|this site uses cookies\b|please enable javascript\b|skip to (main )?content\b|share (this|on)\b"
    r"|subscribe to\b|sign (in|up)\b|log ?in\b|click here\b|read more\b|back to top\b|lorem ipsum\b)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row, however often the body's loops use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows of a text."""
    numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    add = lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"))
    return F.aggregate(let(numbered, starts), none, add, lambda a: a["n"])


def n_repeat_words(words: Column) -> Column:
    def of_windows(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered_words(g))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def line_passes(line: Column, words: Column) -> Column:
    """The rules of one line; an empty line passes, it has nothing to lose."""
    n = F.size(words)
    letters = lambda c: F.length(F.regexp_replace(line, c, ""))
    navigation = F.regexp_count(line, F.lit(SYMBOLS)) * 5 > n
    shouting = (letters(r"[^\p{L}]") > 10) & (letters(r"[^\p{Lu}]") * 2 > letters(r"[^\p{L}]"))
    stuck = (n >= JUDGED) & (F.size(F.array_distinct(words)) * 3 < n)
    fragment = (n < FRAGMENT) & ~line.rlike(END_MARK)
    return (n == 0) | ~(navigation | shouting | stuck | fragment | line.rlike(NOTICE))


def with_line_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    base_failed, kept and clean_text.

    Null text counts as empty: no words, so base_failed and not kept.  Each row is judged by itself, so
    repeated rows get the same verdict; an empty table stays empty; a very long text is one row of work
    of n log n steps.  Columns of these names in ``docs`` are replaced.
    """
    added = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lost_words base_failed kept clean_text rule_lines rule_words".split()
    docs = docs.drop(*added)
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    split = lambda line: F.filter(F.split(line, SPACES), lambda w: w != "")
    parsed = let(
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), split(x).alias("words"))),
        lambda lines: F.struct(
            F.transform(lines, lambda x: F.struct(x["line"], F.size(x["words"]).alias("n"), line_passes(x["line"], x["words"]).alias("ok"))).alias("lines"),
            F.flatten(F.transform(lines, lambda x: x["words"])).alias("words"),
        ),
    )
    total = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + x["n"])
    counted = let(
        parsed,
        lambda p: F.struct(
            F.size(p["words"]).cast("long").alias("n_words"),
            F.length(F.array_join(p["words"], "")).cast("long").alias("word_chars"),
            n_repeat_words(p["words"]).cast("long").alias("n_repeat_words"),
            let(F.transform(F.filter(p["lines"], lambda x: x["n"] > 0), lambda x: x["line"]), lambda x: F.size(x) - F.size(F.array_distinct(x)))
            .cast("long")
            .alias("n_dup_lines"),
            total(F.filter(p["lines"], lambda x: ~x["ok"])).cast("long").alias("n_lost_words"),
            F.array_join(F.transform(F.filter(p["lines"], lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("clean_text"),
        ),
    )
    out = docs.select(*columns, counted.alias("rule_lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    out = out.select(*columns, "rule_lines.*", "n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST * F.col("n_words"))
    )


#: The same over whole texts in DuckDB, with its constants written out.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT rid, k, line, words, len(words) AS n FROM (
    SELECT rid, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line,
           regexp_extract_all(unnest(ls), '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM texts))
), judged AS (
  SELECT *, n = 0 OR NOT (
      len(regexp_extract_all(line, '[#*$%&|<>]')) * 5 > n
      OR (length(regexp_replace(line, '[^\p{L}]', '', 'g')) > 10
          AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) * 2 > length(regexp_replace(line, '[^\p{L}]', '', 'g')))
      OR (n >= 8 AND len(list_distinct(words)) * 3 < n)
      OR (n < 4 AND NOT regexp_matches(line, '[.!?…:;\"''”’»)\]]\s*$'))
      OR regexp_matches(line, '(?i)^\W*(all rights reserved|licensed under\b|released under\b|this work is licensed\b|copyright\b|©|powered by\b|terms of (use|service)\b|privacy policy\b|cookie (policy|settings)\b|accept (all )?cookies\b|this site uses cookies\b|please enable javascript\b|skip to (main )?content\b|share (this|on)\b|subscribe to\b|sign (in|up)\b|log ?in\b|click here\b|read more\b|back to top\b|lorem ipsum\b)')) AS ok
  FROM lines
), per_text AS (
  SELECT rid, sum(n)::BIGINT AS n_words, coalesce(sum(n) FILTER (NOT ok), 0)::BIGINT AS n_lost_words,
         count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
  FROM judged GROUP BY rid
), whole AS (
  SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars FROM texts
), windows AS (
  SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM whole WHERE len(w) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(8, i - before))::BIGINT AS n FROM (
    SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8) AS before FROM twice) GROUP BY rid
), counted AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lost_words,
         n_words < 20 OR 100 * coalesce(covered.n, 0) > 30 * n_words AS base_failed
  FROM whole JOIN per_text USING (rid) LEFT JOIN covered USING (rid)
)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM counted
"""
