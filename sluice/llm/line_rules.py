"""Quality rules on lines first, then on what is left of the document.

Every line is judged by rules of three kinds, and lines that fail one are removed:

* punctuation: more than one odd sign for three words, or thirty words without a sentence mark;
* navigation: up to twenty words with two separators between them, or nothing but a menu word;
* boilerplate: up to forty words with a phrase of notices, banners and forms.

A document goes if it loses more than half of its words that way. Before that it must pass base rules:
fifty words, and no more than half of them in three-word windows that come again in the text.

All of it is expressions over arrays of a row's own lines and words: no Python, no shuffle, so a hot
source, repeated documents or common lines cost nothing extra. Windows are sorted with their places
and equal neighbours found, which is exact.

Null text has no words and lines. Lines without a word neither fail nor count. Repeated rows give one
row each, a null id stays null, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, MOST_LOST_PERCENT = 50, 50, 50

ODD_SIGN = r"[#*$%&|<>{}=+~^_\x5C]|!!|[?][?]|[.][.][.][.]"
WORDS_PER_ODD_SIGN = 3
SENTENCE_MARK = "[.!?:;…。！？]"
LIST_WORDS = 30
SEPARATOR = r"[\x20\x09][|»›•·>/][\x20\x09]"
MENU_WORDS = 20
MENU = (
    r"(?i)^[\x20\x09]*(home|menu|next|previous|prev|back|top|search|login|log in|sign in|sign up|register|contact|contact us|about|about us|"
    r"sitemap|read more|more|share|print|page [0-9]+( of [0-9]+)?)[\x20\x09\x0D]*$"
)
PHRASE = (
    r"(?i)(all rights reserved|(use|accept)s? (of )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|enable javascript|"
    r"click here|subscribe to|sign up for|follow us on|share (this|on)|powered by|lorem ipsum|skip to (main )?content|back to top)"
)
PHRASE_WORDS = 40


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a rule. What is found in few lines is looked for first, since counting
    costs more than looking."""
    words = _count(line, WORD)
    odd = line.rlike(ODD_SIGN) & (_count(line, ODD_SIGN) * WORDS_PER_ODD_SIGN > words)
    listed = ~line.rlike(SENTENCE_MARK) & (words >= LIST_WORDS)
    # neighbouring separators share a blank, so each counts with the blank after it doubled
    separated = line.rlike(SEPARATOR) & (_count(F.replace(line, F.lit(" "), F.lit("  ")), SEPARATOR) >= 2)
    navigation = (separated & (words <= MENU_WORDS)) | line.rlike(MENU)
    boilerplate = line.rlike(PHRASE) & (words <= PHRASE_WORDS)
    return odd | listed | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three that the array has twice or more."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda word, i: F.concat_ws(" ", word, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(found: Column) -> Column:
        same = lambda i, j: F.get(found, i)["text"] == F.get(found, j)["text"]
        again = F.filter(F.transform(found, lambda w, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), w["at"])), lambda at: at.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda at: F.array(at, at + 1, at + 2)))))

    def counted(texts: Column) -> Column:
        in_order = F.sort_array(F.transform(texts, lambda text, i: F.struct(text.alias("text"), i.alias("at"))))
        # most texts have no window twice, and nothing to sort
        return F.when(F.size(F.array_distinct(texts)) == F.size(texts), 0).otherwise(_once(in_order, covered))

    return _once(windows, counted).cast("long")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` made once: the element of an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a word),
    n_failed_lines, n_words_left, kept and text (of the lines left) for every row."""
    without = lambda text, signs: F.translate(text, signs, "")
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    split = texts.select(
        "id", "text",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    judged = split.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda line: F.struct(line.alias("line"), line.rlike(WORD).alias("worded"), (line.rlike(WORD) & line_fails(line)).alias("fails"))).alias("lines"),
    )
    lines = lambda keep: F.transform(F.filter("lines", keep), lambda x: x["line"])
    found = judged.select(
        "*", lines(lambda x: x["worded"]).alias("worded"), F.array_join(lines(lambda x: ~x["fails"]), "\n").alias("text"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
    ).withColumn("n_words_left", F.when(F.col("n_failed_lines") == 0, F.col("n_words")).otherwise(_count(F.col("text"), WORD)).cast("long"))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    lost = (F.col("n_words") - F.col("n_words_left")) * 100 > F.col("n_words") * MOST_LOST_PERCENT
    return found.select(
        "id", "n_words", "word_chars", "n_symbols", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        base_failed.alias("base_failed"), F.size("worded").cast("long").alias("n_lines"), "n_failed_lines", "n_words_left", (~base_failed & ~lost).alias("kept"), "text",
    )


_N = f"len(regexp_extract_all(line, '{WORD}'))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d)),
g AS (
  SELECT r, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS t, lead(word, 2) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g WHERE whole) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM a, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (
  SELECT r, line, {_N} AS n,
         len(regexp_extract_all(line, '{ODD_SIGN}')) * {WORDS_PER_ODD_SIGN} > {_N}
         OR ({_N} >= {LIST_WORDS} AND NOT regexp_matches(line, '{SENTENCE_MARK}'))
         OR ({_N} <= {MENU_WORDS} AND len(regexp_extract_all(replace(line, ' ', '  '), '{SEPARATOR}')) >= 2) OR regexp_matches(line, '{MENU}')
         OR ({_N} <= {PHRASE_WORDS} AND regexp_matches(line, '{PHRASE}')) AS fails
  FROM l WHERE regexp_matches(line, '{WORD}')),
s AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n)::BIGINT AS n_words, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost
  FROM f GROUP BY r),
b AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN s USING (r) LEFT JOIN p USING (r)),
c AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MOST_LOST_PERCENT} * n_words AS kept
FROM c
"""
