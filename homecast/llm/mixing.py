"""Mixing sources to target weights (DataFrame functions only).

Every source is one long run of its documents' words, cut into blocks of ``block``
words (the last one may be shorter).  The mix is a run of slots, one block each, dealt to
output shards of ``shard_slots`` slots.  Per shard the slots are drawn from the sources:
each source gets the whole part of its expected count, and the slots that remain are a
multinomial draw over the fractional parts.  (Drawing all slots so has the same
expectation but strays by the square root of the count, too far for small sources.)  The
j-th slot of a source maps to a block by a pseudorandom permutation of the source's block
indices, another one on each pass over the source; slots join blocks by index.

Defined cases: a null text has no words and takes nothing; a null source is the last
source; documents are told apart by id, text and row, so repeated rows stand in the source as
often as they occur and share its blocks; ties need no rule, as the order inside a source
is by hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    field, keyed, materialize, n_words, running_start, text_or_empty, unit_interval, unpacked,
)

BLOCK = 64
SHARD_SLOTS = 65_536
#: Slots that one row stands for when a shard's slots are dealt out to tasks.
CHUNK = 4_096
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, MOST_PASSES = 1.5, 2
#: Steps of a walk that leaves the index range: an index outside is permuted again until
#: it is inside.  At most sqrt(n) + 1 indices are outside, so up to 4,096 blocks the walk
#: always ends in time; beyond, it fails to with a chance below n ** -32, and the query
#: then stops with an error.
WALK = 64


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
            most: float = MOST_PASSES) -> DataFrame:
    """sizes(source, source_size, ...) -> also weight and target.  One row per source.

    The targets are ``least(most * size, level * weight)``: sources are sorted by the level
    at which they stop, and the level is the first that keeps all later ones below."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1,
                                                   F.lit(len(weights))))
    df = sizes.withColumn("weight", w).withColumn(
        "_stop", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_stop", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    df = df.withColumn("_total", F.lit(float(total_share)) * F.sum("source_size").over(everything))
    df = df.withColumn("_stopped", F.lit(float(most)) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)))
    df = df.withColumn("_rest", F.sum("weight").over(everything)
                       - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if exactly the sources before this one stop; it holds if this one does not.
    df = df.withColumn("_level", (F.col("_total") - F.col("_stopped")) / F.col("_rest"))
    df = df.withColumn("_holds", F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct(
        "_stop", "_level"))).over(everything)["_level"])
    target = F.least(F.lit(float(most)) * F.col("source_size"),
                     F.col("_holds") * F.col("weight"))
    return df.withColumn("target", F.coalesce(target, F.lit(0.0))).drop(
        "_stop", "_total", "_stopped", "_rest", "_level", "_holds")


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: four mixing rounds over index = (x, y) in an
    a x b grid with a * b >= n; an index outside is permuted again."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / F.greatest(a, F.lit(1))).cast("long")

    def rounds(i: Column) -> Column:
        x, y = i % a, F.floor(i / a).cast("long")
        for k in range(2):
            x = F.pmod(x + F.xxhash64(y, F.lit(2 * k), *seed) % a, a)
            y = F.pmod(y + F.xxhash64(x, F.lit(2 * k + 1), *seed) % b, b)
        return y * a + x

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(index),
                       lambda i, _: F.when(i < n, i).otherwise(rounds(i)))
    found = F.when(rounds(index) < n, rounds(index)).otherwise(walk)
    return F.when(found < n, found).otherwise(
        F.raise_error(F.lit("index walk did not end")).cast("long"))


def shard_draws(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """sources(source_no, expected) -> (source_no, shard, drawn, first): how many slots of
    the shard the source gets, and the index of the first of them among all its slots."""
    df = sources.withColumn("_total", F.sum("expected").over(Window.partitionBy()))
    total = F.col("_total")
    df = df.withColumn("_p", F.when(total > 0, F.col("expected") / total).otherwise(0.0))
    df = df.withColumn("_shards", F.ceil(total / shard_slots).cast("int"))
    df = df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    # The last shard has the slots that remain.
    slots = F.least(F.lit(float(shard_slots)), F.ceil(total).cast("double")
                    - F.col("shard") * F.lit(float(shard_slots)))
    df = df.withColumn("_want", slots * F.col("_p")).withColumn("_whole", F.floor("_want"))
    df = df.withColumn("_part", F.col("_want") - F.col("_whole"))
    shard = Window.partitionBy("shard")
    upto = shard.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_parts", F.sum("_part").over(shard)).withColumn(
        "_hi", F.sum("_part").over(upto))
    n_draws = F.round("_parts").cast("int")
    draws = F.filter(F.sequence(F.lit(1), n_draws), lambda k: (
        unit_interval(F.lit(seed), F.col("shard"), k) * F.col("_parts") >= F.col("_hi") - F.col("_part"))
        & (unit_interval(F.lit(seed), F.col("shard"), k) * F.col("_parts") < F.col("_hi")))
    extra = F.when((n_draws > 0) & (F.col("_part") > 0), F.size(draws)).otherwise(0)
    df = df.withColumn("drawn", (F.col("_whole") + extra).cast("long"))
    by_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)
    return df.withColumn("first", F.coalesce(F.sum("drawn").over(by_shard), F.lit(0)).cast("long")) \
        .select("source_no", "shard", "drawn", "first")


def plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
         block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 5, row: str | None = None,
         **target_options):
    """(documents, sources, pieces).  documents: rid (the column ``row``, if given), doc_id, size, source_no; sources: one
    row each with target; pieces: the words of one document in one block, with the number
    of times the mix takes the block (``times``, 0 to 2) and the shards it goes to."""
    rows = materialize(docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("rid"), F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"), n_words(text_or_empty(text)).alias("size"),
        F.xxhash64(text_or_empty(text)).alias("content")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, **target_options).withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    sources = materialize(sources.withColumn("blocks", blocks).withColumn(
        "expected", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks")
                           / F.col("source_size")).otherwise(0.0)))
    by_source = sources.select(F.col("source").alias("_s"), "source_no")
    rows = rows.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).select(
        "rid", "doc_id", "source_no", "size", "content")
    # Every pass over a source takes each block once; a third pass is never begun.
    slots = shard_draws(sources.filter("source_size > 0").select("source_no", "expected"),
                        shard_slots, seed).filter("drawn > 0")
    slots = slots.join(sources.select("source_no", "blocks"), "source_no").select(
        "source_no", "blocks", (F.col("first") + F.col("drawn")).alias("_end"), F.explode(F.sequence(
            F.col("first"), F.col("first") + F.col("drawn") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    # Runs of slots are dealt out before the slots are written down.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots.repartition(parts, "source_no", "_from").select("source_no", "blocks", F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("_end")) - 1)).alias("j"))
    slots = slots.filter(F.col("j") < F.lit(MOST_PASSES) * F.col("blocks"))
    n_pass = F.floor(F.col("j") / F.col("blocks")).cast("long")
    slots = slots.select("source_no", permuted(
        F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), n_pass)
        .alias("block"))
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    started = running_start(rows.filter("size > 0"), ["source_no"], ["doc_id", "content", "rid"],
                            "size", "start")
    pieces = started.select("rid", "source_no", "size", "start", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
        .alias("block"))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    pieces = pieces.select("rid", "source_no", "block", lo.alias("word"), (hi - lo).alias("n"))
    # The planner cannot see how many slots the few source rows become: no broadcast.
    return rows, sources, pieces.join(times.hint("merge"), ["source_no", "block"], "left").select(
        "rid", "word", "n", F.coalesce("times", F.lit(0)).alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, pieces (the parts
    that are taken: first word, words, times)."""
    return mix_rows(docs, **options).drop("rid")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """``mix`` with the row's key (``rid``)."""
    rows, sources, pieces = plan(docs, **options)
    taken = pieces.groupBy("rid").agg(
        F.sum(F.col("n") * F.col("times")).cast("long").alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("times") > 0, F.struct("word", "n", "times"))))
        .alias("pieces"))
    return rows.join(taken, "rid", "left").join(
        sources.select("source_no", "source_size", "target"), "source_no").select(
        "rid", "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: one row per document that the mix takes.
    Its text is the words taken on the first pass, then those of the second, each word with
    the white space before it; a text taken whole stays as it is.  Each row by its own
    pieces, whatever its id."""
    rows = keyed(docs)
    m = mix_rows(rows.select("_row", *[field(c).alias(c) for c in ("doc_id", "source", "text")]),
                 row="_row", **options).filter("taken > 0").select(
        F.col("rid").alias("_key"), F.col("size").alias("_size"), F.col("taken").alias("_taken"),
        F.col("pieces").alias("_pieces"))
    out = rows.join(m, F.col("_row") == F.col("_key"))
    out = out.withColumn("_tokens", F.regexp_extract_all(
        field("text"), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)))

    def one_pass(k: int) -> Column:
        parts = F.transform(F.filter("_pieces", lambda p: p["times"] >= k), lambda p: F.array_join(
            F.slice(F.col("_tokens"), (p["word"] + 1).cast("int"), p["n"].cast("int")), ""))
        return F.array_join(parts, "")

    whole = (F.col("_taken") == F.col("_size")) & F.forall("_pieces", lambda p: p["times"] == 1)
    out = out.withColumn("_text", F.when(whole, field("text")).otherwise(
        F.concat(one_pass(1), F.lit("\n"), one_pass(2))))
    return unpacked(out, docs.columns, text=F.col("_text"), n_chars=F.length("_text").cast("long"))
