"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

The normalised text (all white space deleted) is cut where its content says so: a chunk
ends at the first boundary pair after ``MIN_CHUNK`` characters, or at ``MAX_CHUNK``.
Equal texts have equal cuts.  A chunk is named by its 64-bit hash and length.  The name is
verified: the distinct chunk texts are grouped by name, and where one name stands for
several texts, each gets its own ordinal (by SHA-256); so two chunks have the same
identifier exactly if they have the same characters.  Each chunk moves once, for this check.
A document is then the ordered list of its identifiers, and documents with equal lists are
equal; long texts are not moved again.

Defined cases: a null text counts as empty, and all texts without a non-white character
are equal; of equal texts the row with the most code points stays, then the smallest id (a
null id stands after all others); ``duplicates`` returns repeated rows as often as they
occur, with equal decisions, of which ``deduplicated`` keeps one row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RUN, field, keyed, materialize, rows_with_keys, text_or_empty

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: A boundary: a character of the first class and one of the second (about 1 pair in 100
#: of prose).  Text without such pairs is cut at MAX_CHUNK.
BOUNDARY = "[cs3C#S][eu5EU%]"
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{BOUNDARY})|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_RUN, "")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def default_name(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
            name: Callable[[Column], Column] = default_name) -> DataFrame:
    """doc_id, n_points, text_sha256 and ``recipe``: the ordered list of verified chunk
    identifiers (name, length, ordinal).  The check of the names is one job that runs here;
    its outcome (the names that stand for several chunks) is almost always empty."""
    norm = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("_t")).select(
        "doc_id", F.length("_t").cast("long").alias("n_points"), normalised(F.col("_t")).alias("_n"))
    cut = norm.withColumn("_c", chunks(F.col("_n")))
    distinct = cut.select(F.explode("_c").alias("c")).groupBy("c").agg(F.lit(1).alias("one")) \
        .select(name(F.col("c")).alias("h"), F.length("c").alias("n"), "c")
    shared = materialize(distinct.groupBy("h", "n").agg(
        F.count("*").alias("texts"), F.collect_set(F.sha2("c", 256)).alias("digests"))
        .filter("texts > 1").select("h", "n", F.sort_array("digests").alias("digests")))
    out = cut.select("doc_id", "n_points", F.sha2("_n", 256).alias("text_sha256"), "_c")
    plain = F.transform("_c", lambda c: F.struct(
        name(c).alias("h"), F.length(c).alias("n"), F.lit(0).alias("ordinal")))
    if shared.isEmpty():
        return out.select("doc_id", "n_points", "text_sha256", plain.alias("recipe"))
    # Names that stand for several chunks: tell those chunks apart by the ordinal.
    rid = F.monotonically_increasing_id()
    rows = out.select(rid.alias("rid"), "doc_id", "n_points", "text_sha256",
                      F.transform("_c", lambda c: F.struct(
                          name(c).alias("h"), F.length(c).alias("n"),
                          F.sha2(c, 256).alias("d"))).alias("parts"))
    rows = materialize(rows)
    each = rows.select("rid", F.posexplode("parts").alias("pos", "p")).select(
        "rid", "pos", "p.h", "p.n", "p.d").join(shared, ["h", "n"], "left").select(
        "rid", F.struct("pos", "h", "n", F.coalesce(
            F.array_position("digests", F.col("d")), F.lit(0)).cast("int").alias("ordinal")).alias("p"))
    lists = each.groupBy("rid").agg(F.sort_array(F.collect_list("p")).alias("ps")).select(
        "rid", F.transform("ps", lambda p: F.struct(
            p["h"].alias("h"), p["n"].alias("n"), p["ordinal"].alias("ordinal"))).alias("recipe"))
    empty = F.array().cast("array<struct<h:bigint,n:int,ordinal:int>>")
    return rows.drop("parts").join(lists, "rid", "left").select(
        "doc_id", "n_points", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Documents meet their group's choice in a join on the recipe; the choice is one row per
    group and aggregated map-side, so a group of any size is never in one task."""
    r = materialize(recipes(docs, **options))
    # ~id falls as the id grows and can't overflow; a null id stands last.
    rank = F.coalesce(F.bitwise_not("doc_id"), F.lit(-(1 << 63)))
    best = r.groupBy("recipe").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_points", rank.alias("rank"))).alias("_best")).withColumnRenamed("recipe", "_r")
    out = r.join(best, F.col("recipe") == F.col("_r"))
    keep = F.when(F.col("_best.rank") != F.lit(-(1 << 63)), F.bitwise_not("_best.rank"))
    return out.select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: one row per distinct normalised text, of equal ids the first."""
    rows = keyed(docs)
    key = F.struct(field("doc_id").alias("id"), F.col("_row").alias("row")).alias("key")
    r = recipes(rows.select(key, field("text").alias("text")), id_col="key", **options)
    best = r.groupBy("recipe").agg(F.max(F.struct(
        "n_points", F.col("doc_id.id").isNotNull().alias("named"), F.bitwise_not("doc_id.id").alias("rank"),
        F.bitwise_not("doc_id.row").alias("row"))).alias("_best"))
    return rows_with_keys(rows, best.select(F.bitwise_not("_best.row").alias("_key")), docs.columns)
