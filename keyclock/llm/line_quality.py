"""Line-first cleaning: rules on every line, then documents that lose too much are rejected. DataFrame expressions only.

A line goes if it breaks one of these rules: a sentence ends in it, or it ends in closing punctuation, and marks are not more than half
as many as its words; it is no navigation (three or more of | > » · between its words); it is no boilerplate (notices of
rights and licences, cookies, scripts, log-in and share links). A document is kept if its base measures allow it and the lines that go
hold at most ``most_lost`` of its word characters.

Everything is computed inside the row, in time that is linear in the text but for one sort, so neither sources nor copies matter and
nothing is shuffled. Windows of five words are compared by 64-bit hashes inside one text. Nulls: a null or empty text has
no words and fails the base measures. Repeated rows get equal results, null ids are carried along; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import SPACE, WORD, let

_WHITE = r"\x20\x09-\x0D"
_SYMBOLS = "#*$%&|<>"
#: A sentence ends somewhere in the line, or the line ends in closing punctuation.
_CLOSING = r"""[.!?…。！？]["'”’»)\]]?(?:\s|$)|[:;,"'”’»)\]]$"""
#: What marks a line as boilerplate, in any case.
_NOTICES = (
    "all rights reserved",
    "copyright",
    "licen[sc]ed under",
    "released under the",
    "terms of (?:use|service)",
    "privacy policy",
    "cookies?",
    "javascript",
    "(?:log|sign) ?in",
    "subscribe",
    "click here",
    "read more",
    "share (?:on|this)",
    "lorem ipsum",
)
_BOILERPLATE = rf"\b(?:{'|'.join(_NOTICES)})\b|©"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def number_of(text: Column, characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more."""

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def doubles(s: Column) -> Column:
        same = lambda x, y: x["h"] == y["h"]
        return F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])

    def count(h: Column) -> Column:
        # most texts repeat no window; only the others are sorted
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(let(placed, doubles)), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    return let(words, lambda w: F.when(F.size(w) > width, let(windows(w), count)).otherwise(0)).cast("long")


def line_kept(line: Column) -> Column:
    """Whether a line with a word passes the rules."""
    marks, words = number_of(line, "!?" + _SYMBOLS), number_of(line, _WHITE) + 1
    return F.rtrim(line).rlike(_CLOSING) & (2 * marks <= words) & (number_of(line, "|>»·") < 3) & ~F.lower(line).rlike(_BOILERPLATE)


def assessed(docs: DataFrame, most_lost: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept and cleaned_text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    worded = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    judged = F.transform("lines", lambda x: F.struct(x.alias("line"), (F.length(x) - number_of(x, _WHITE)).alias("n"), line_kept(x).alias("ok")))
    words = let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    rows = rows.select("doc_id", "t", words.alias("w"), worded.alias("lines")).select("doc_id", "t", "w", "lines", judged.alias("x"))
    rows = rows.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        (F.length("t") - number_of(F.col("t"), _WHITE)).cast("long").alias("word_chars"),
        number_of(F.col("t"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.aggregate(F.filter("x", lambda y: ~y["ok"]), F.lit(0), lambda a, y: a + y["n"]).cast("long").alias("lost_chars"),
        F.array_join(F.transform(F.filter("x", lambda y: y["ok"]), lambda y: y["line"]), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
