"""Filter audit, lexical search and learned partitions against brute force, on small and odd
tables."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from homecast.llm import filter_audit, learned_partitions, lexical_search, registry

WORD = re.compile(r"[^\x20\t-\r]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("_id", "_row", "_part", "_n", "_key", "_vec", "rank", "score", "_text", "filter", "step")


def with_clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


# ------------------------------------------------------------------ sorted lists, graphs
LISTS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(st.lists(LISTS, max_size=6))
def test_unions_and_differences(lists):
    assert filter_audit.union(lists) == sorted(set().union(*lists))
    for a, b in itertools.combinations(lists, 2):
        assert filter_audit.minus(a, b) == sorted(set(a) - set(b))
        assert filter_audit.shared(a, b) == len(set(a) & set(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), unique=True), min_size=1, max_size=9))
def test_graph_gives_the_plain_sums(items):
    graph = lexical_search.Graph(items)
    assert graph.additions <= graph.plain
    r = random.Random(1)
    value = {t: r.randint(0, 1000) for t in range(26)}
    node = [sum(value[t] for t in leaf) for leaf in graph.leaves]
    for a, b in graph.sums:
        node.append(node[a] + node[b])
    assert [sum(node[p] for p in ps) for ps in graph.parts] == [sum(value[t] for t in ts) for ts in items]
    for pair in itertools.combinations(range(len(node)), 2):  # nothing is left to share
        assert sum(set(pair) <= set(ps) for ps in graph.parts) < 2


# -------------------------------------------------------------------------- 12 the audit
@pytest.fixture(scope="module")
def audited(spark):
    r = random.Random(5)
    texts = []
    for _ in range(150):
        n = r.choice([3, 40, 60, 90])
        words = [f"w{r.randint(0, r.choice([20, 400]))}" for _ in range(n)]
        if r.random() < 0.3:
            words.append(r.choice(["#", "a|b", "100%", "$5"]))
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        texts.append(" ".join(words))
    texts += texts[:20] + texts[:5] + [None, None, "", " \n", "one " * 200, "É" * 90, "w1 w2"] + ["x" * 300_000]
    rows = [(i if i % 19 else None, t, ["a", "b", "b", "b", None][i % 5]) for i, t in enumerate(texts)]
    rows += rows[:4]
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(1, 170, 2)]
    labels += [(1, 1, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and i > first[t]}
        parts[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x[0][f] for x in found) - len(gone),
                    sum(x[0][f] and sum(x[0].values()) == 1 for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark, audited, monkeypatch):
    rows, labels = audited
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 16)  # many ranges
    docs = with_clash(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    marks = with_clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost,
                                               x.shapley] for x in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    got = filter_audit.audit(one, marks).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(x.kept, x.removed) for x in got] == [(0, 1), (0, 0), (0, 0), (0, 0), (0, 0)]


# ---------------------------------------------------------------------- 11 lexical search
@pytest.fixture(scope="module")
def searched():
    r = random.Random(8)
    vocabulary = [a + b for a in "bdklmnprst" for b in ("a", "e", "io", "u", "é")]
    text = lambda n: " ".join(r.choice(vocabulary[:r.choice([8, 50])]) for _ in range(n))
    docs = [(i, text(r.randint(1, 120))) for i in range(400)]
    docs += [(900 + i, docs[7][1]) for i in range(70)] + [docs[3], docs[3], (None, docs[5][1]), (None, None), (901, "")]
    docs += [(902, "Ba-BA_ba; ba"), (903, "§§ ba la"), (904, "... !!"), (905, "la" * 200_000), (906, "ba " * 50_000)]
    items = [(i, text(r.randint(1, 30))) for i in range(25)]
    items += [items[4], (100, items[4][1] + " la"), (101, None), (102, ""), (103, "nowhere"), (None, "BA ba"), (104, "la§")]
    return docs, items


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_search(docs, items, top):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item_id, t in items:
        found = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 20 * m))
                        for x in set(TERM.findall(lower(t))) if c[x])
            if score:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[item_id, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("block_terms, pairs", [(lexical_search.BLOCK_TERMS, lexical_search.GRAPH_PAIRS), (60, 300)])
def test_search_matches_brute_force(spark, searched, monkeypatch, block_terms, pairs):
    docs, items = searched
    monkeypatch.setattr(lexical_search, "GRAPH_PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "SAMPLED", 3)
    got = lexical_search.search(with_clash(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)),
                                with_clash(spark.createDataFrame(items, "item_id long, text string")),
                                top=20, block_terms=block_terms).collect()
    assert Counter((x.item_id, x.rank, x.doc_id, x.score) for x in got) == brute_search(docs, items, 20)


def test_search_of_nothing(spark, searched):
    docs, items = searched
    empty_docs = spark.createDataFrame([], "doc_id long, text string")
    empty_items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs[:3], empty_docs.schema)
    assert lexical_search.search(empty_docs, spark.createDataFrame(items, empty_items.schema)).count() == 0
    assert lexical_search.search(some, empty_items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None)], empty_docs.schema),
                                 spark.createDataFrame(items, empty_items.schema)).count() == 0


# ---------------------------------------------------------------------- 13 near vectors
def brute_nearest(rows, k, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 6
            and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = Counter()
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            found = [(-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), j)
                     for there, (j, x) in enumerate(good) if there != at]
            for rank, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in found)[:k], 1):
                out[i, rank, j, round(-s, 9)] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(50 * i, rows[50][1]) for i in (7, 8, 9)]
    rows += [rows[100], rows[100], (400, rows[100][1]), (None, rows[0][1]), (500, None), (550, []), (600, [0.0] * 6),
             (650, [1.0, None, 0, 0, 0, 0]), (700, [math.nan] * 6), (750, [math.inf, 1, 1, 1, 1, 1]), (800, [1.0] * 5),
             (-50, [-x for x in rows[3][1]])]
    return [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


def test_nearest_with_all_parts_match_brute_force(spark, vectors):
    df = with_clash(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4))
    got = learned_partitions.search(df, lambda i: F.pmod(i, F.lit(50)) == 0).collect()
    assert Counter((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in got) == brute_nearest(vectors, 5)


def test_nearest_in_small_blocks(spark, vectors, monkeypatch):
    """Several parts, blocks and tiles: all found scores are right, and nearly all neighbours."""
    for name, value in (("PART_ROWS", 40), ("BLOCK_ROWS", 16), ("TILE_ROWS", 2)):
        monkeypatch.setattr(learned_partitions, name, value)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    got = learned_partitions.search(df, lambda i: F.pmod(i, F.lit(50)) == 0, recall=1.0).collect()
    got = Counter((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in got)
    want = brute_nearest(vectors, 5)
    assert sum(got.values()) == sum(want.values())
    assert sum((got & want).values()) > 0.8 * sum(want.values())


def test_nearest_few_and_extreme_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    search = lambda rows: learned_partitions.search(
        spark.createDataFrame(rows, schema), lambda i: F.pmod(i, F.lit(50)) == 0).collect()
    assert search([]) == [] and search([(0, None)]) == [] and search([(0, [1.0, 0.0])]) == []
    tiny, huge = [1e-40, 2e-40], [1e38, 2e38]
    got = search([(0, tiny), (1, huge), (2, [2.0, -1.0])])
    assert [(x.query_id, x.rank, x.vec_id) for x in got] == [(0, 1, 1), (0, 2, 2)]
    assert got[0].score == pytest.approx(1.0, abs=1e-4) and got[1].score == pytest.approx(0.0, abs=1e-4)


def test_parts_are_balanced_and_follow_the_graph():
    r = np.random.default_rng(3)
    centres = r.standard_normal((8, 12)) * 4
    which = np.repeat(np.arange(8), 64)
    x = learned_partitions.unit(centres[which] + r.standard_normal((512, 12)) * 0.5)
    near = learned_partitions.nearest(x, x, 10, np.arange(512))
    part = learned_partitions.balanced_parts(near, 8)
    assert np.bincount(part).tolist() == [64] * 8
    assert (part[near] == part[:, None]).mean() > 0.95
    w, probes = learned_partitions.fit(x, 8)
    assert probes <= 2


def test_recall_on_the_given_vectors(spark):
    """Held against brute force, with the production parameters."""
    at = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    a = learned_partitions.unit(np.array(at.embedding.tolist(), float))
    ids = at.vec_id.to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    true = learned_partitions.nearest(a, a[asked], 5, asked)
    got = registry.QUERIES["op13_learned_partitions"](spark, "/root/testdata/sf0.1").toPandas()
    found = got.groupby("query_id").vec_id.apply(set)
    hits = [len(found[i] & set(ids[t].tolist())) for i, t in zip(ids[asked], true)]
    assert len(got) == 5 * len(asked) and sum(hits) >= 0.9 * len(got)
