"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set is its distinct shingles of ``width`` words (A-Z lowered).  Documents with the same
   words in the same order are one class, named by a 128-bit digest; from here on one
   representative, the smallest id, stands for the class.
2. ``BANDS`` bands of ``ROWS`` minima put representatives into buckets.
3. In rounds, each bucket's members meet a few pivots of the bucket (1, then 32, 1,024, ...),
   unless they are in the pivot's component already.  A pivot that has met its bucket
   leaves it, so every pair of a bucket meets unless it is connected already, and a bucket
   of copies is done in its first round.  Pivots come from the bucket's largest components.
   What the first round leaves open is narrowed exactly: pairs whose first shared shingle, in
   order of frequency, may be one of at most ``RARE`` documents are listed and verified
   (prefix filter); any other pair has only frequent shingles in common, and does not meet if
   these are too few for the threshold.
4. A pair is verified in sequence: batch by batch, further minima are compared, and the
   pair is dropped as soon as the posterior chance that its similarity reaches the
   threshold (uniform prior) is below ``MISS``.
5. Survivors are confirmed on their full sets, read from the texts, and linked.

At similarity 0.8 a pair meets in no band with a chance of 7e-6, and is dropped in step 4 with
one of at most ``MISS`` per batch.  No bucket or partner is capped.

Defined cases: a null text counts as empty; a document without words has the empty set and
is linked with nothing, as is one with a null id; repeated rows are one class; ties go to
the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, keyed, materialize, rows_with_keys
from .components import components

#: Words of a shingle.
WIDTH = 2
#: Similarity in percent; bands, minima in a band; minima in a batch, batches; miss chance.
PERCENT = 80
BANDS, ROWS = 30, 5
BATCH, BATCHES = 16, 4
MISS = 1e-6
#: A shingle in so many open documents or fewer is rare.
RARE = 100
#: Pivots of a bucket in the first round, and how many times more in each next one.
FIRST_PIVOTS, PIVOT_GROWTH = 1, 32
_KEPT_WORDS = 400_000


class WordHash(dict):
    """64-bit hashes of words; the table is emptied when it is full, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds with fixed odd constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """The words, A-Z lowered; bytes split and lower by ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int = WIDTH) -> set:
    """The distinct runs of ``width`` words; all words as one run if there are fewer."""
    return set(zip(*(words[k:] for k in range(min(width, len(words))))))


def shingle_hashes(words: list[bytes], table: WordHash, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    run = _mixed(h[:n])
    for k in range(1, width):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(run)


@functools.lru_cache(maxsize=1)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def minima(hashes: np.ndarray, n: int, step: int = 4096) -> np.ndarray:
    a, b = _multipliers(n)
    x, best = (hashes >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        y = x[i:i + step, None] * a + b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(best, y.min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, key (digest of the words; null without words), bands, minima."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = WordHash()
        salt = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            sizes, keys, bands, rest = [], [], [], []
            for s in batch.column(1):
                words = split_words(s.as_py())
                if not words:
                    sizes.append(0), keys.append(None), bands.append(None), rest.append(None)
                    continue
                hashes = shingle_hashes(words, table, width)
                m = minima(hashes, BANDS * ROWS + BATCH * BATCHES)
                grid, h = m[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64), salt
                for k in range(ROWS):
                    h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                bands.append(h.view(np.int64))
                rest.append(m[BANDS * ROWS:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                ["doc_id", "n_shingles", "key", "bands", "minima"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sign, "doc_id long, n_shingles long, key binary, bands array<long>, minima binary")


def rare_shingles(texts: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """texts(id, text) -> (id, n shingles, common: those in more than ``RARE`` rows) and the
    pairs a < b whose first shared shingle may be a rarer one.

    Shingles are in order of rows, then hash.  A pair at the threshold shares one among the
    first n - ceil(percent * n) + 1 of either side, the first that it shares at all.  If that
    one is rare the pair is listed here; if not, all that the pair shares is frequent, so its
    intersection is at most the smaller ``common``.  Neither are pairs listed whose sizes alone
    keep them below the threshold.  By 64-bit hash: equal hashes of different shingles could
    only make more pairs or a larger ``common``."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = WordHash()
        for batch in batches:
            sets = [shingle_hashes(split_words(s.as_py()), table, width).view(np.int64) for s in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "h"])

    rows = materialize(texts.select("id", "text").mapInArrow(hashed, "id long, h array<long>"))
    each = rows.select("id", F.explode("h").alias("h"))
    few = each.groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") <= RARE)
    rare = materialize(each.join(few, "h"))
    counts = rows.select("id", F.size("h").cast("long").alias("n")).join(
        rare.groupBy("id").agg(F.count("*").alias("rare")), "id", "left").select(
        "id", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common"))
    counts = materialize(counts)
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    # The first ones by document: rare shingles come before all others.
    heads = rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rows", "h"))).alias("l")).join(
        counts, "id").select("id", "n", F.explode(F.slice("l", F.lit(1), first.cast("int"))).alias("s"))
    shared = heads.filter("s.rows > 1").select(F.col("s.h").alias("h"), F.col("id").alias("a"), F.col("n").alias("n_a"))
    other = shared.select("h", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return counts, shared.join(other, "h").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The least number of equal minima of ``n`` at which the similarity may still reach the
    threshold: with a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def plausible(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs(a, b, minima_a, minima_b): those that no batch rules out."""
    bounds = [least_matches(BATCH * k, percent) for k in range(1, BATCHES + 1)]

    def prune(batches: Iterator) -> Iterator:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(
                batch.num_rows, BATCH * BATCHES) for c in ("minima_a", "minima_b"))
            left, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, bound in enumerate(bounds):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[left] += (x[left, part] == y[left, part]).sum(axis=1)
                left = left[matches[left] >= bound]
            yield batch.take(left).select(["a", "b"])

    return pairs.mapInArrow(prune, "a long, b long")


def confirmed(pairs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """pairs(a, b, text_a, text_b): those that reach the threshold on their full sets."""

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, first = None, set()
        for batch in batches:
            keep = []
            for a, s, t in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if a != last:
                    last, first = a, shingle_set(split_words(s.as_py()), width)
                other = shingle_set(split_words(t.as_py()), width)
                both = len(first & other)
                keep.append(100 * both >= percent * (len(first) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(confirm, "a long, b long")


def linked(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = materialize(signatures(docs, id_col, text, width))
    classes = materialize(signed.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep")))
    reps = signed.filter("key IS NOT NULL").join(
        classes.select(F.col("key").alias("_k"), "rep"),
        (F.col("key") == F.col("_k")) & (F.col("doc_id") == F.col("rep"))).select(
        "rep", "n_shingles", "bands", "minima").dropDuplicates(["rep"])
    members = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = materialize(members.join(shared, "band", "left_semi"))
    ids = members.select("id").distinct()
    # The texts and minima of representatives that share a bucket: read once, used by all rounds.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(
        ids, "id", "left_semi")
    minima_of = signed.select(F.col("doc_id").alias("id"), "minima").join(ids, "id", "left_semi")
    known = materialize(texts.join(minima_of, "id").dropDuplicates(["id"]))
    labels, counts, pivots = None, None, FIRST_PIVOTS
    while True:
        at = members.withColumn("label", F.col("id")) if labels is None else members.join(
            labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_bands = at.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
            .filter("lo <> hi").select("band")
        at = materialize(at.join(open_bands, "band", "left_semi"))
        if at.isEmpty():
            break
        pairs, may = None, F.lit(True)
        if pivots > FIRST_PIVOTS:  # what the first round leaves open
            if counts is None:
                counts, pairs = rare_shingles(known.join(at.select("id").distinct(), "id", "left_semi"), percent, width)
                label = lambda c: at.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")).distinct()
                pairs = pairs.join(label("a"), "a").join(label("b"), "b").filter("_a <> _b").select("a", "b")
            at = materialize(at.join(counts, "id"))
            most = F.least("common", "pivot_common")
            may = F.lit(100) * most >= F.lit(percent) * (F.col("n") + F.col("pivot_n") - most)
        else:
            at = at.withColumns({"n": F.lit(0), "common": F.lit(0)})
        # The salts' pivots come from the bucket's largest components: the rest of a large
        # component need not meet them, and those outside it soon find a link into it.
        size = at.groupBy("band", "label").agg(F.count("*").alias("size"))
        rank = F.struct("size", "common", F.xxhash64("id").alias("h"), "id", "label", "n")
        chosen = at.join(size, ["band", "label"]).groupBy(
            "band", F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots)).alias("_salt")).agg(
            F.max(rank).alias("p")).select(
                F.col("band").alias("_band"), F.col("p.id").alias("pivot"), F.col("p.label").alias("pivot_label"),
                F.col("p.n").alias("pivot_n"), F.col("p.common").alias("pivot_common"))
        chosen = materialize(chosen)
        # A pair that shares several bands meets in the least of them in which its pivot is one.
        bands = at.groupBy("id").agg(F.collect_set("band").alias("bands"))
        pivot_bands = chosen.groupBy("pivot").agg(F.collect_set("_band").alias("pivot_bands"))
        once = F.col("band") == F.array_min(F.array_intersect("bands", "pivot_bands"))
        met = at.join(bands, "id").join(
            chosen.join(pivot_bands, "pivot"),
            (F.col("band") == F.col("_band")) & (F.col("label") != F.col("pivot_label")) & may & once).select(
            F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        met = (met if pairs is None else met.union(pairs)).distinct()
        side = lambda c, *cols: known.select(F.col("id").alias(c), *[
            F.col(x).alias(f"{x}_{c}") for x in cols])
        left = plausible(met.join(side("a", "minima"), "a").join(side("b", "minima"), "b").select(
            "a", "b", "minima_a", "minima_b"), percent)
        links = materialize(confirmed(left.join(side("b", "text"), "b").join(side("a", "text"), "a").select(
            "a", "b", "text_a", "text_b"), percent, width))
        if not links.isEmpty():
            if labels is not None:  # links between components
                for c in ("a", "b"):
                    links = links.join(labels.select(F.col("id").alias(c), F.col("label").alias("_l")), c, "left") \
                        .withColumn(c, F.coalesce("_l", c)).drop("_l")
            roots = components(links).select(F.col("a").alias("_old"), F.col("root").alias("_new"))
            fresh = roots.select(F.col("_old").alias("id"), F.col("_new").alias("label"))
            if labels is not None:
                moved = labels.join(roots, F.col("label") == F.col("_old"), "left").select(
                    "id", F.coalesce("_new", "label").alias("label"))
                fresh = moved.union(fresh.join(labels, "id", "left_anti"))
            labels = materialize(fresh)
        members = at.select("band", "id").join(
            chosen.select(F.col("_band").alias("band"), F.col("pivot").alias("id")), ["band", "id"], "left_anti")
        pivots *= PIVOT_GROWTH
    root = classes if labels is None else classes.join(
        labels.withColumnRenamed("id", "rep"), "rep", "left")
    root = root.select("key", F.col("rep").alias("_root")) if labels is None else root.select(
        "key", F.coalesce("label", "rep").alias("_root"))
    out = signed.select("doc_id", "n_shingles", "key").join(root, "key", "left")
    component = F.when(F.col("doc_id").isNull() | F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("_root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: the one with the smallest id (null ids last), of equal ids the
    first.  Rows are linked by keys of their own, so repeated ids and null ids are no case
    apart; a row without words is a group of its own."""
    rows = keyed(docs)
    found = linked(rows.select("_row", field("text").alias("text")), id_col="_row", **options)
    ids = rows.select(F.col("_row").alias("_r"), field("doc_id").alias("_i"))
    best = found.join(ids, F.col("doc_id") == F.col("_r")).groupBy("component_id").agg(
        F.min(F.struct(F.col("_i").isNull().alias("unnamed"), "_i", "_r")).alias("_best"))
    return rows_with_keys(rows, best.select(F.col("_best._r").alias("_key")), docs.columns)
