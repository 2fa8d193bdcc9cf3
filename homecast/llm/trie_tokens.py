"""Token counts by trie-shared dynamic programming.

A unigram tokenizer splits each pre-token (a word with its opening mark) into the pieces
with the highest total score.  The distinct pre-tokens are range-partitioned and sorted, so a
task walks them as a trie, depth first: the forward scores of a prefix are computed once and
shared by all words below it, and the count of a word is what its last node holds.

Pieces come from a public vocabulary file (never trained here); the r-th piece in the file's
order of merit has the score -ln(r + 2), a Zipf law.  A character that no piece covers costs
one token for each of its bytes, at the score of a piece ranked last.

Defined cases: a null text counts as empty and has no tokens; of equally scored splits the
one with fewer tokens counts; repeated rows get equal counts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .word_table import add_up, count_words, split

MARK = "▁"
#: Distinct words of one task.
TASK_WORDS = 100_000


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    own.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(own)}


class Trie:
    """The path from the root to the last word: a node per character, with the best
    (score, tokens) of the prefix that ends there."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=0)
        self.last = -math.log(len(scores) + 2)
        self.word, self.best, self.nodes = "", [(0.0, 0)], 0

    def count(self, word: str) -> tuple[float, int]:
        """Score and tokens of ``word``; the prefix it shares with the word before is kept."""
        old, i = self.word, 0
        most = min(len(word), len(old))
        while i < most and word[i] == old[i]:
            i += 1
        best, scores = self.best, self.scores
        del best[i + 1:]
        for end in range(i + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score, n = best[end - 1]
            top, tokens = score + n_bytes * self.last, n + n_bytes
            for begin in range(max(0, end - self.longest), end):
                s = scores.get(word[begin:end])
                if s is not None:
                    before, n = best[begin]
                    if before + s > top or (before + s == top and n + 1 < tokens):
                        top, tokens = before + s, n + 1
            best.append((top, tokens))
        self.nodes += len(word) - i
        self.word = word
        return best[-1]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, score (sum of the best splits')."""
    words = materialize(count_words(docs, text, split))
    n = words.count()

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie = Trie(pieces(model))
        for batch in batches:
            found = [trie.count(MARK + w.as_py().decode("utf-8", "surrogatepass")) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("total"), pa.array([float(t) for _, t in found], pa.float64()),
                 pa.array([s for s, _ in found], pa.float64())], ["word", "total", "n_tokens", "score"])

    values = materialize(words.repartitionByRange(max(1, -(-n // TASK_WORDS)), "word").sortWithinPartitions("word")
                         .mapInArrow(walk, "word binary, total long, n_tokens double, score double"))
    out = add_up(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", split, values,
                 ["n_tokens", "score"], ["doc_id"])
    return out.select("doc_id", F.col("n_words").alias("n_pretokens"),
                      F.round("n_tokens").cast("long").alias("n_tokens"), "score")
