"""Distinct words with their counts, and sums over each document's words.

Work on words is done once per distinct word; documents then add up their words' values.
The most frequent words (a fixed number, of bounded length) go to every task; the rest of
each document's words, about a tenth, meets its values in a join.  Texts are split and looked
up a column at a time, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows and bytes per word of the table that every task gets.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Distinct words, and bytes of them, that a task gathers before it hands them on.
GATHERED, GATHERED_BYTES = 250_000, 1 << 25
#: Bytes of text that are split at a time (a longer text is split alone).
PIECE_BYTES = 1 << 22

#: From a column of texts (an Arrow array): the words of all of them (an Arrow array, in any
#: order) and each one's row (a numpy array).
Split = Callable[..., tuple]


class _Places(dict):
    """Row numbers by word, ``other`` for those it does not hold."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.other = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.other


def split(texts) -> tuple:
    """The maximal runs of other characters than white space (``common.WHITE``); a null text
    has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # not before a leading space, nor after a last one
    if not full.all():
        words, rows = words.filter(pa.array(full)), rows[full]
    return words.cast(pa.binary()), rows


def pieces(batches: Iterator, column: int) -> Iterator:
    """The batches in pieces of about ``PIECE_BYTES`` bytes in this column."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begins = [*np.flatnonzero(np.diff(size // PIECE_BYTES, prepend=-1)).tolist(), batch.num_rows]
        for begin, end in zip(begins, begins[1:]):
            yield batch.slice(begin, end - begin)


def larger(batches: Iterator, rows: int = 50_000) -> Iterator:
    """The batches put together to about ``rows`` rows each."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_words(docs: DataFrame, text: str, split: Split, learn: Column | None = None,
                groups: int = 1) -> DataFrame:
    """word, total, learned: occurrences in all documents, and in those of each group (an
    array).  ``learn`` is a document's group, -1 for none."""

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(held: list):
            coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
            counts, begin = np.zeros((len(coded.dictionary), groups + 1), np.int64), 0
            for words, own in held:  # a part has a word once
                counts[coded.indices[begin:begin + len(words)].to_numpy()] += own
                begin += len(words)
            return pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(counts.sum(axis=1)),
                 *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(groups)]],
                ["word", "total", *[f"g{k}" for k in range(groups)]])

        held, n, size = [], 0, 0
        for piece in pieces(batches, 0):
            words, rows = split(piece.column(0))
            coded = words.dictionary_encode()
            group = piece.column(1).to_numpy().astype(np.int64)
            group[group < 0] = groups  # the last: documents of no group
            at = coded.indices.to_numpy().astype(np.int64) * (groups + 1) + group[rows]
            distinct = len(coded.dictionary)
            held.append((coded.dictionary, np.bincount(at, minlength=distinct * (groups + 1)).reshape(-1, groups + 1)))
            n, size = n + distinct, size + coded.dictionary.nbytes
            if n >= GATHERED or size >= GATHERED_BYTES:
                yield out(held)
                held, n, size = [], 0, 0
        if n:
            yield out(held)

    names = [f"g{k}" for k in range(groups)]
    learn = F.lit(0) if learn is None else learn.cast("int")
    parts = docs.select(F.col(text).alias("text"), learn.alias("learn")).mapInArrow(
        gather, "word binary, total long" + "".join(f", {c} long" for c in names))
    return parts.groupBy("word").agg(
        F.sum("total").alias("total"), *[F.sum(c).alias(c) for c in names]).select(
        "word", "total", F.array(*names).alias("learned"))


def frequent(values: DataFrame) -> DataFrame:
    """The words that occur most, ``FREQUENT`` at most: those of the highest classes of
    ``total`` (eight to a doubling) that fit.  Only the classes' sizes are collected."""
    level = F.floor(F.log2("total") * 8)
    short = values.filter((F.length("word") <= FREQUENT_BYTES) & (F.col("total") > 0))
    sizes = sorted(((r["level"], r["n"]) for r in short.groupBy(level.alias("level")).agg(
        F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for k, n in sizes:
        held += n
        if held > FREQUENT:
            break
        least = k
    return short.filter(F.lit(False) if least is None else level >= least)


def add_up(docs: DataFrame, text: str, split: Split, values: DataFrame, names: list[str],
           keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every document with n_words and, for each of ``names``, the sum
    of ``values``' column of this name over the document's words (as doubles).

    values: word, total and the columns ``names``; it must hold every word."""
    top = frequent(values).select("word", *names).toPandas()
    table = np.zeros((len(names), len(top) + 1))  # the last: words that are not among them
    table[:, :-1] = top[names].to_numpy(dtype=np.float64).T
    known = docs.sparkSession.sparkContext.broadcast(([bytes(w) for w in top["word"]], table))

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, table = known.value
        places = _Places(held)
        item = pa.struct([("word", pa.binary()), ("n", pa.int64())])
        for piece in pieces(batches, len(keep)):
            words, rows = split(piece.column(len(keep)))
            coded = words.dictionary_encode()
            number, distinct = coded.indices.to_numpy(), coded.dictionary
            at = np.fromiter(map(places.__getitem__, distinct.to_pylist()), np.int64, len(distinct)).take(number)
            sums = [np.bincount(rows, x.take(at), piece.num_rows).astype(np.float64) for x in table]
            other = at == len(held)  # once per document: by row and number
            row_word, times = np.unique(rows[other] * len(distinct) + number[other], return_counts=True)
            row, word = np.divmod(row_word, max(1, len(distinct)))
            ends = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays(
                [distinct.take(pa.array(word)), pa.array(times.astype(np.int64))], fields=list(item))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(np.bincount(rows, minlength=piece.num_rows).astype(np.int64)),
                 *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), rare)],
                [*keep, "n_words", *names, "rare"])

    src = docs.select(*keep, F.col(text).alias("_text"))
    schema = src.select(*keep).schema.simpleString()[7:-1]
    schema = f"{schema},n_words long,{','.join(f'{c} double' for c in names)},rare array<struct<word:binary,n:long>>"
    rows = materialize(src.mapInArrow(partial, schema).withColumn("_rid", F.monotonically_increasing_id()))
    rest = rows.select("_rid", F.explode("rare").alias("r")).select("_rid", "r.word", "r.n").join(
        values.select("word", *names), "word").groupBy("_rid").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(f"_{c}") for c in names])
    return rows.join(rest, "_rid", "left").select(
        *keep, "n_words", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in names])
