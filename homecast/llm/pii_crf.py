"""Personal data by a skip-chain conditional random field.

Fixed patterns give the base spans (e-mail, ip, card, phone) in code points.  They label the
tokens of all documents, and the field's factors are estimated from them piecewise, by
counts over the corpus: token shape against label, neighbouring labels, and how often two
tokens of a document with the same core agree.  The shapes are coarse (runs of digits and
letters, the punctuation, the length), so a token that no pattern matches can still look like
one that does: a phone number without its plus, a mail address cut at a line end.

Each document is then a graph: its tokens, chain links between neighbours, and skip links
that tie each token to the one before with the same core (its letters or digits only, or its
mail name), however far.  Loopy belief propagation passes sum-product messages for ``ROUNDS``
rounds; a token whose chance of a label exceeds ``SURE`` and that overlaps no base span becomes a
further span.  Base spans always stay.

A document is taken into the graph only if some token has a shape that a labelled token has
had: in all others every unary factor is the same and every token keeps the label "other".

Defined cases: a null text counts as empty and has no spans; ties in place are ordered by
kind; repeated rows are learned as often as they occur and get equal spans; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: inside a run it would have succeeded from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\t-\r]+")
DIGIT = re.compile(r"[0-9]")
#: Rounds of messages; chance from which a token becomes a span; smoothing of the counts.
ROUNDS, SURE, SMOOTH = 8, 0.9, 0.5
#: The longest shape that is told apart; longer ones share one name.
SHAPE = 16
LABELS = ("other", *KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from the ``@`` signs: the search starts at the run of name
    characters before each, so text without one is never scanned."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = [(a, 0, b) for a, b in _mails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def shape(token: str) -> str:
    """Digits as ``9`` with their number, letters as ``a``, other characters as they are."""
    s = re.sub(r"[^\W\d_]+", "a", token.rstrip(".,;:!?"))
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 9)}", s)
    return s if len(s) <= SHAPE else s[:SHAPE] + "~"


def core(token: str) -> str | None:
    """What tokens are linked by: the mail name, or the digits (5 or more); None for others."""
    if "@" in token:
        name = token.split("@")[0].lower()
        return name if len(name) >= 4 else None
    digits = re.sub("[^0-9]", "", token)
    if len(digits) >= 5:
        return digits
    name = token.strip(".,;:!?()<>\"'").lower()
    return name if len(name) >= 4 and re.search(r"[0-9._]", name) else None


class Document:
    """Tokens with places, shapes, base labels and skip links."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        places = [m.span() for m in TOKEN.finditer(text)]
        self.start = np.array([a for a, _ in places], np.int64)
        self.end = np.array([b for _, b in places], np.int64)
        self.label = np.zeros(len(places), np.int64)
        for a, kind, b in reversed(spans):  # the first span of a token counts
            self.label[np.searchsorted(self.end, a, side="right"):np.searchsorted(self.start, b)] = kind + 1
        self.shapes = [shape(text[a:b]) for a, b in places]
        last: dict[str, int] = {}
        links = []
        for i, (a, b) in enumerate(places):
            c = core(text[a:b])
            if c is not None:
                if c in last:
                    links.append((last[c], i))
                last[c] = i
        self.skip = np.array(links, np.int64).reshape(-1, 2)


def plain(text: str) -> bool:
    """No digit and no mail sign: no token of it has a shape that a base span's token can
    have, except for those of letters only, which count as "other"."""
    return "@" not in text and not DIGIT.search(text)


def factor_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, a, b, n: the counts that the factors come from, over all documents.

    ``shape``: shape and label; ``chain``: neighbouring labels; ``skip``: labels of linked
    tokens.  Documents without digits and mail signs have labels "other" only; their
    tokens count in the chain and under one common shape."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: Counter = Counter()
        for batch in batches:
            for s in batch.column(0):
                t = s.as_py() or ""
                if plain(t):
                    words = len(t.split())
                    n["shape", "a", "0"] += words
                    n["chain", "0", "0"] += max(0, words - 1)
                    continue
                d = Document(t, base_spans(t))
                n.update(("shape", x if re.search("[9@]", x) else "a", str(y)) for x, y in zip(d.shapes, d.label))
                n.update(("chain", str(x), str(y)) for x, y in zip(d.label, d.label[1:]))
                n.update(("skip", str(d.label[i]), str(d.label[j])) for i, j in d.skip)
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k in keys], pa.string()) for i in range(3)], pa.array([n[k] for k in keys], pa.int64())],
            ["kind", "a", "b", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(
        count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Field:
    """The factors as logarithms: by shape, between neighbours, along skip links."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        k = len(LABELS)
        by_shape: dict[str, np.ndarray] = {}
        tables = {"chain": np.full((k, k), SMOOTH), "skip": np.eye(k) * 4 + SMOOTH}
        for kind, a, b, n in rows:
            if kind == "shape":
                by_shape.setdefault(a, np.zeros(k))[int(b)] += n
            else:
                tables[kind][int(a), int(b)] += n
        total = sum(by_shape.values(), np.zeros(k)) + 1
        prior = total / total.sum()
        # P(label | shape) over P(label): what the shape alone says.
        self.prior = np.log(prior)
        self.unary = {s: np.log((c + SMOOTH * prior) / (c + SMOOTH * prior).sum()) - self.prior for s, c in by_shape.items()}
        self.plain = self.unary.get("a", np.log(np.array([1.0, *[1e-6] * (k - 1)])) - self.prior)

        def pair(t: np.ndarray) -> np.ndarray:  # joint over the product of its margins
            joint = (t + t.T) / (2 * t.sum())
            return np.log(joint) - np.log(joint.sum(axis=0))[:, None] - np.log(joint.sum(axis=1))[None, :]

        self.chain, self.skip = pair(tables["chain"]), pair(tables["skip"])
        self.telling = {s for s, c in by_shape.items() if c[1:].any()}

    def node(self, shapes: list[str]) -> np.ndarray:
        none = np.zeros(len(LABELS))
        return np.array([self.unary.get(s, none) if re.search("[9@]", s) else self.plain for s in shapes]) + self.prior


def marginals(d: Document, field: Field) -> np.ndarray:
    """Chances of the labels by loopy belief propagation.  Tokens whose place is certain
    (base spans) are held at their labels."""
    n, k = len(d.label), len(LABELS)
    node = field.node(d.shapes)
    held = d.label > 0
    node[held] = np.where(np.arange(k) == d.label[held][:, None], 0.0, -50.0)
    chain = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    edges = np.concatenate([chain, d.skip])
    # Directed: each link once in each direction; its reverse is E places on.
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    e = len(edges)
    reverse = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    along = np.concatenate([np.arange(e) >= n - 1] * 2)
    message = np.zeros((2 * e, k))
    for _ in range(ROUNDS):
        belief = node.copy()
        np.add.at(belief, b, message)
        out = belief[a] - message[reverse]
        for which, table in ((~along, field.chain), (along, field.skip)):
            x = out[which][:, :, None] + table[None]
            top = x.max(axis=1, keepdims=True)
            fresh = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            message[which] = 0.5 * message[which] + 0.5 * (fresh - fresh.max(axis=1, keepdims=True))
    belief = node
    np.add.at(belief, b, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def further_spans(text: str, spans: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Tokens that the field labels and no base span covers."""
    d = Document(text, spans)
    if not field.telling.intersection(d.shapes):
        return []
    p = marginals(d, field)
    best = p[:, 1:].argmax(axis=1)
    sure = (p[np.arange(len(p)), best + 1] > SURE) & (d.label == 0)
    found = []
    for i in np.flatnonzero(sure):
        token = text[d.start[i]:d.end[i]]
        end = int(d.end[i]) - (len(token) - len(token.rstrip(".,;:!?")))
        if not any(a < end and d.start[i] < b for a, _, b in spans):
            found.append((int(d.start[i]), int(best[i]), end))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of start, kind_no, kind, end, base; sorted)."""
    rows = [tuple(r) for r in factor_counts(docs, text).collect()]  # by shape and label: bounded
    field = docs.sparkSession.sparkContext.broadcast(Field(rows))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("kind", pa.string()),
                          ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            out = []
            for s in batch.column(1):
                t = s.as_py() or ""
                spans, more = [], []
                if not plain(t):
                    spans = base_spans(t)
                    more = further_spans(t, spans, field.value)
                out.append([{"start": a, "kind_no": kind, "kind": KINDS[kind], "end": b, "base": base}
                            for (a, kind, b), base in sorted([*((x, True) for x in spans), *((x, False) for x in more)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        find, "doc_id long, spans array<struct<start:long,kind_no:int,kind:string,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["base"])
    kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[kind(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
