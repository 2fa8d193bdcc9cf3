"""Secret scans by corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by fixed patterns in whole texts, with their places in code points.
The hash of each candidate's value is counted over the corpus by distinct repositories and
distinct owners.  A value that at least ``EXAMPLE_OWNERS`` owners hold is a widely copied
example; one that a single owner holds looks live.  Besides the fixed kinds, a run that
mixes cases and digits (``owned``) becomes a span if it looks live and overlaps no other.

Defined cases: a null text has no candidates; a null owner or repository counts as one
owner or repository of its own; a repeated row gets an equal result and adds no owner; ties
in place are ordered by kind; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Fixed patterns: kind, pattern, group of the value, characters it needs.
KINDS = [
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20),
]
BASE = ("assign", "access", "hex")
EXAMPLE_OWNERS = 3


def _found(text: Column, kind: int) -> Column:
    """Array of (kind, i, gap, whole, value): the i-th match of the pattern, the length of
    the text between it and the one before, its length and its value."""
    _, pattern, group, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v"), gaps.alias("g")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"),
        F.length(x["w"]).alias("n"), x["v"].alias("value")))
    # The last gap has no match after it.
    return F.when(F.regexp_like(text, F.lit(pattern)), F.slice(rows, F.lit(1), F.size(rows) - 1)) \
        .otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,value:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str | Column = "source",
         repo: str | Column = "lang", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: doc_id, found (array of start, kind_no, kind, end, owners,
    repos, verdict; sorted)."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("_t"),
                      F.coalesce(as_col(owner).cast("string"), F.lit("")).alias("owner"),
                      F.coalesce(as_col(repo).cast("string"), F.lit("")).alias("repo"))
    rows = materialize(src.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo",
        F.concat(*[_found(F.col("_t"), k) for k in range(len(KINDS))]).alias("hits")))
    hits = rows.select("rid", "owner", "repo", F.explode("hits").alias("x")).select(
        "rid", "owner", "repo", "x.*")
    before = Window.partitionBy("rid", "kind").orderBy("i")
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before)).withColumn(
        "start", F.col("end") - F.col("n"))
    least = F.get(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind"))
    mixes = (F.col("kind") != 3) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]")
                                    & F.col("value").rlike("[A-Z]"))
    hits = hits.filter((F.length("value") >= least) & mixes).withColumn("h", F.sha2("value", 256))
    spread = hits.select("h", "owner", "repo").distinct().groupBy("h").agg(
        F.count_distinct("owner").alias("owners"), F.count("*").alias("repos"))
    hits = hits.select("rid", "start", "kind", "end", "h").join(spread, "h")
    names = F.get(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(
        F.col("owners") == 1, "live").otherwise("shared")
    lists = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.col("kind").alias("kind_no"), names.alias("kind"), "end", "owners", "repos",
        verdict.alias("verdict")))).alias("f"))
    base = F.filter("f", lambda x: x["kind_no"] < 3)
    lists = lists.withColumn("b", base)
    found = F.filter("f", lambda x: (x["kind_no"] < 3) | ((x["verdict"] == "live") & ~F.exists(
        "b", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))
    empty = F.array().cast(
        "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,owners:bigint,repos:bigint,verdict:string>>")
    lists = lists.select("rid", found.alias("found"))
    return rows.select("rid", "doc_id").join(lists, "rid", "left").select(
        "doc_id", F.coalesce("found", empty).alias("found"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans, and all spans as text."""
    kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    said = lambda v: F.size(F.filter("found", lambda x: x["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", *[kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_text(F.filter("found", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        said("live").alias("n_live"), said("example").alias("n_example"))
