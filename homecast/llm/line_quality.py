"""Quality rules: cross-document line frequency (DataFrame functions only).

Each worded line is normalised (A-Z lowered, digit runs to ``0``, white runs to one
space, trimmed) and hashed.  Per host, the distinct documents that hold a line are
counted; documents with the same text count as one, so copies of a page do not turn its
own lines into boilerplate.  A line in more than ``max_docs`` documents of a host is
removed; the limit does not rise with the host.  A document that keeps less than ``min_left`` of its
words is depleted and rejected, as is one that fails the base rules.

Defined cases: a null text has no words and fails the base rules; a null host is a host
of its own; a repeated row counts once in the frequencies and gets its own equal verdict;
an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RUN, field, keyed, materialize, text_or_empty, unpacked, words

#: Fixed limits of the base rules.
MIN_WORDS = 50
MAX_REPEAT = 0.5
SYMBOLS = "[#*$%&|<>]"
WORDED = "[^\\x20\\x09-\\x0D]"


def normalised_line(line: Column) -> Column:
    low = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    return F.btrim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), WHITE_RUN, " "),
                   F.lit(WHITE))


def line_key(line: Column) -> Column:
    return F.xxhash64(normalised_line(line))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORDED))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the
    arrays ``_words`` and ``_lines`` they come from.

    Repeated 3-word windows: the windows' hashes are sorted with their positions, those
    equal to a neighbour are the starts of repeated windows, and each start covers up to
    three words that the next start does not."""
    df = df.withColumn("_text", text_or_empty(text))
    df = df.withColumn("_words", words(F.col("_text"))).withColumn(
        "_lines", worded_lines(F.col("_text")))
    size = F.size("_words")
    df = df.withColumn("_win", F.when(size >= 3, F.slice(F.transform(
        "_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
        F.lit(1), size - 2)))
    df = df.withColumn("_sorted", F.when(
        F.size("_win") > F.size(F.array_distinct("_win")),
        F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter(
        "_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"])
        | (x["h"] == F.get("_sorted", i + 1)["h"])), lambda x: x["p"])))
    covered = F.aggregate(F.transform("_starts", lambda p, i: F.least(
        F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *[c for c in df.columns if c not in ("_win", "_sorted", "_starts", "_text")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def verdicts(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text: str = "text",
             max_docs: int = 8, min_left: float = 0.3) -> DataFrame:
    """One row per document: id, base counts, base_failed, n_lines_removed,
    removed_words, removed_lines (hashes), kept.  A line that more than ``max_docs`` distinct
    documents of a host hold is removed, whatever the host's size.

    One pass reads the texts and writes a small profile (counts and line hashes);
    everything else reads that."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"),
                      F.col(text).alias("text"))
    profile = base_counts(src).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "host",
        F.xxhash64(text_or_empty("text")).alias("content"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.transform("_lines", lambda x: F.struct(
            line_key(x).alias("h"), F.size(words(x)).alias("n"))).alias("lines"))
    profile = materialize(profile)
    lines = profile.select("rid", "host", "content", F.explode("lines").alias("l")).select(
        "rid", "host", "content", "l.h", "l.n")
    in_docs = lines.groupBy("host", "h").agg(F.count_distinct("content").alias("docs"))
    common = in_docs.filter(F.col("docs") > max_docs).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    removed = lines.join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h"))) \
        .groupBy("rid").agg(F.count("*").alias("n_lines_removed"), F.sum("n").alias("removed_words"),
                            F.collect_set("h").alias("removed_lines"))
    out = profile.drop("lines", "content").join(removed, "rid", "left").drop("rid")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        gone.alias("removed_words"), "removed_lines",
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose normalised hash is in ``removed``."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~(
        x.rlike(WORDED) & F.array_contains(removed, line_key(x))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their common lines removed and n_chars to match; each
    row by its own verdict, whatever its id."""
    rows = keyed(docs)
    v = verdicts(rows.select("_row", field("source").alias("source"), field("text").alias("text")),
                 id_col="_row", **options).filter("kept").select(F.col("doc_id").alias("_key"), "removed_lines")
    out = rows.join(v, F.col("_row") == F.col("_key"))
    out = out.withColumn("_text", without_lines(field("text"), F.col("removed_lines")))
    n_chars = F.when(F.col("removed_lines").isNotNull(), F.length("_text").cast("long")) \
        .otherwise(field("n_chars")) if "n_chars" in docs.columns else None
    return unpacked(out, docs.columns, text=F.col("_text"), n_chars=n_chars)
