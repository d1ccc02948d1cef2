"""Line-first quality rules (built-in column functions only).

Every line of a text is judged alone by a navigation, a boilerplate and a
punctuation rule; failing lines are cut out and a document is rejected when it
loses too much of its text that way.  Whole-document counts (words, symbols,
repeated lines, repeated three-word windows) come beside the line verdicts.

Each document is evaluated inside its own row: there is no shuffle, so skewed
sources and groups of copies cost nothing extra.

Edge cases: a null text counts as no words and is not kept; an empty text has
one empty line, which is neither kept nor counted; repeated rows give repeated
results; an empty table gives an empty result; only ``text_col`` is read, other
columns pass through unless they carry the name of an output (those are
replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import fresh, quoted

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = SYMBOLS + "!?.,;:-_=+/\\~^@()[]{}\"'`"
END_MARKS = ".!?:;)]\"'”»…"
TERMINAL = r"[.!?:;)\]\"'”»…][ \t\x0b\x0c\r]*$"
LINE_ENDS = "\x85\u2028\u2029"      # what a pattern's $ also allows at the very end
MENU = r"^(home|about|about us|contact|contact us|login|log in|sign in|sign up|register|menu|search|next|previous|back to top|site ?map|read more|share|subscribe|faq|help)$"
BOILERPLATE = (r"(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept (all )?cookies|"
               r"enable javascript|javascript is (disabled|required)|copyright (©|\(c\))|click here to|subscribe to our|"
               r"lorem ipsum|powered by wordpress)")

#: Each boilerplate phrase holds one of these, so that lines without any need no pattern.
HINTS = ["reserved", "terms of ", "policy", "cookies", "javascript", "copyright ", "click here", "subscribe", "lorem", "wordpress"]
LABEL = 12      # visible characters of the longest menu label, and some

OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "n_lines", "n_nav_lines", "n_boiler_lines", "n_punct_lines", "line_chars", "lost_chars", "clean_text"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def line_rule(line: Column, min_words: int = 8, max_punct_pct: int = 15) -> Column:
    """0 keep, 1 navigation, 2 boilerplate, 3 punctuation, 4 no word in the line.

    navigation: three or more separators (``|``, ``>``, ``»``, ``•``) with at
    most four words for each, or a bare menu label; boilerplate: a fixed legal
    or site phrase; punctuation: over ``max_punct_pct`` per cent of the visible
    characters are punctuation, or a line of fewer than ``min_words`` words that
    ends without a terminal mark.
    """
    return _step(F.length(_without(line, SPACES)), lambda visible: _rule_of(line, visible, min_words, max_punct_pct))


def _step(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _terminal(line: Column) -> Column:
    """Whether the line matches TERMINAL; its last visible character tells, unless that is a line end of its own."""
    return _step(F.right(F.rtrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(1)), lambda last: F.when(
        last.isin(*END_MARKS), True).when(last.isin(*LINE_ENDS), line.rlike(TERMINAL)).otherwise(False))


def _rule_of(line: Column, visible: Column, min_words: int, max_punct_pct: int) -> Column:
    marks = F.length(line) - F.length(_without(line, "|>»•"))
    words = F.size(F.split(F.regexp_replace(line, r"^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$", ""), r"[ \t\x0b\x0c\r]+"))
    punct = F.length(line) - F.length(_without(line, PUNCTUATION))
    hinted = lambda low: reduce(or_, [low.contains(h) for h in HINTS]) & low.rlike(BOILERPLATE)
    return (F.when(visible == 0, 4)
            .when(((marks >= 3) & (words <= marks * 5)) | ((visible <= LABEL) & F.trim(F.lower(line)).rlike(MENU)), 1)
            .when(_step(F.lower(line), hinted), 2)
            .when((punct * 100 > visible * max_punct_pct) | (~_terminal(line) & (words < min_words)), 3)
            .otherwise(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by three-word windows that the text holds twice or more.

    Most texts repeat no window; the number of distinct 64-bit hashes tells, and
    only texts with a repeat pay for the sort that carries positions.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # one pass over the sorted (hash, position) pairs keeps those with an equal neighbour
    twice = F.transform(F.array(placed), lambda s: F.sort_array(F.transform(F.filter(
        s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["p"])))
    covered = F.get(F.transform(twice, lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"])), 0)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0)).cast("long")


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50,
                  max_lost_pct: int = 30) -> DataFrame:
    """Add the rule columns ``OUTPUTS`` to each document.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_pct``
    per cent of them in repeated three-word windows.  ``kept``: not base_failed
    and the cut lines hold at most ``max_lost_pct`` per cent of the visible
    characters.  ``clean_text`` is the text without the cut lines.
    """
    clash = [c for c in docs.columns if c.lower() in OUTPUTS and c != text_col]
    t, w, h, ln, bad = (fresh(docs, s) for s in ("txt", "words", "hashes", "lines", "bad"))
    d = docs.drop(*clash).withColumn(t, F.coalesce(F.col(quoted(text_col)), F.lit("")))
    d = d.withColumn(w, F.regexp_extract_all(F.col(t), F.lit(f"({WORD})"), F.lit(1)))
    words = F.col(w)
    d = d.withColumn(h, F.when(F.size(words) >= 4, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn(ln, F.transform(F.split(F.col(t), "\n"), lambda x: F.struct(
        x.alias("line"), line_rule(x).alias("rule"), F.length(_without(x, SPACES)).alias("chars"))))
    lines = F.col(ln)
    worded = F.transform(F.filter(lines, lambda x: x["chars"] > 0), lambda x: x["line"])

    def total(rule: int) -> Column:
        return F.size(F.filter(lines, lambda x: x["rule"] == rule)).cast("long")

    def chars(cut: bool) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"),
                           lambda a, x: a + F.when(x["rule"].between(1, 3) if cut else F.lit(True), x["chars"]).otherwise(0))

    d = d.select(
        *[F.col(quoted(c)) for c in docs.columns if c not in clash],
        F.size(words).cast("long").alias("n_words"),
        chars(False).alias("word_chars"),
        (F.length(F.col(t)) - F.length(_without(F.col(t), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(h)).alias("n_repeat_words"),
        F.size(worded).cast("long").alias("n_lines"),
        total(1).alias("n_nav_lines"), total(2).alias("n_boiler_lines"), total(3).alias("n_punct_lines"),
        chars(False).alias("line_chars"), chars(True).alias("lost_chars"),
        F.array_join(F.transform(F.filter(lines, lambda x: x["rule"] == 0), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_pct * F.col("line_chars")))


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Quality rules over every document (doc_id, base counts, line verdicts, digest of the cleaned text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_nav_lines", "n_boiler_lines", "n_punct_lines", "line_chars", "lost_chars",
        F.md5("clean_text").alias("clean_md5"))


def _q(s: str) -> str:
    return s.replace("'", "''")


_SP = "[ \\t\\x0b\\x0c\\r]"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words FROM d),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'p': i, 'g': words[i] || ' ' || words[i+1] || ' ' || words[i+2]}})) AS x
        FROM w WHERE len(words) >= 4),
rep AS (SELECT doc_id, x.p AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x.g) > 1),
cov AS (SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, least(3, p - lag(p, 1, -5) OVER (PARTITION BY doc_id ORDER BY p)) AS c FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lm AS (SELECT *, length(regexp_replace(line, '[ \t\x0b\x0c\r]', '', 'g')) AS visible,
          length(line) - length(translate(line, '|>»•', '')) AS marks,
          len(string_split_regex(regexp_replace(line, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}+')) AS nw,
          length(line) - length(translate(line, '{_q(PUNCTUATION)}', '')) AS punct, lower(line) AS low FROM ln),
lr AS (SELECT *, CASE WHEN visible = 0 THEN 4
          WHEN (marks >= 3 AND nw <= marks * 5) OR regexp_matches(trim(low, ' '), '{_q(MENU)}') THEN 1
          WHEN regexp_matches(low, '{_q(BOILERPLATE)}') THEN 2
          WHEN punct * 100 > visible * 15 OR (nw < 8 AND NOT regexp_matches(line, '{_q(TERMINAL)}')) THEN 3
          ELSE 0 END AS rule FROM lm),
la AS (SELECT doc_id, count(*) FILTER (visible > 0) AS n_lines,
          count(*) FILTER (visible > 0) - count(DISTINCT line) FILTER (visible > 0) AS n_dup_lines,
          count(*) FILTER (rule = 1) AS n_nav_lines, count(*) FILTER (rule = 2) AS n_boiler_lines, count(*) FILTER (rule = 3) AS n_punct_lines,
          coalesce(sum(visible), 0) AS line_chars, coalesce(sum(visible) FILTER (rule BETWEEN 1 AND 3), 0) AS lost_chars,
          coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (rule = 0), '') AS clean FROM lr GROUP BY doc_id),
a AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
          length(t) - length(translate(t, '{_q(SYMBOLS)}', '')) AS n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
          n_lines, n_nav_lines, n_boiler_lines, n_punct_lines, line_chars, lost_chars, clean
      FROM w JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= 30 * line_chars AS kept,
       n_lines::BIGINT AS n_lines, n_nav_lines::BIGINT AS n_nav_lines, n_boiler_lines::BIGINT AS n_boiler_lines,
       n_punct_lines::BIGINT AS n_punct_lines, line_chars::BIGINT AS line_chars, lost_chars::BIGINT AS lost_chars, md5(clean) AS clean_md5
FROM b
"""
