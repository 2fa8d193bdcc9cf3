"""The corpus operators against brute force, on small and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from homecast.llm import (
    best_fit, chunk_dedup, common, context_mixing, license_scan, line_quality, minhash_bayes, mixing, pii_crf,
    registry, secret_scan, token_ids, trie_tokens, word_contexts, word_table,
)
from homecast.llm.components import components

WORD = re.compile(r"[^\x20\t-\r]+")
WHITE = re.compile(r"[\x20\t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ("_id", "_text", "rid", "band", "label", "removed_lines", "_pieces", "_tokens", "start", "recipe", "_doc")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(r: random.Random, n: int) -> str:
    vocabulary = [f"{a}{b}{c}" for a in "btkmrs" for b in "aeiou" for c in ("n", "l", "st", "")]
    out = []
    for i in range(n):
        out.append(r.choice(vocabulary) + (".\n" if r.random() < 0.08 else " "))
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    """Plain and odd documents: nulls, empty and long texts, ties, copies, near copies,
    shared lines, personal data, secrets, notices."""
    r = random.Random(11)
    texts = [prose(r, r.randint(60, 300)) for _ in range(40)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1], texts[1] + "\n", texts[1]]
    for i in (2, 2, 3, 3, 3):
        words = texts[i].split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = "Read more on our site today\n"
    texts += [shared * 3 + prose(r, 90) for _ in range(12)] + [shared + "  " + str(i) for i in range(3)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "Two WORDS", "a b c d e", prose(r, 6000)]
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts += [f"password = '{secret}' and {prose(r, 60)}", f"api_key:{secret}", "token: short secret=abcdefgh",
              "AKIA" + "Q" * 16 + " AKIA12", "x9Yz" * 7 + " plain", "word " * 200]
    card = "4111 1111 1111 1111"
    texts += [f"write to ann.lee7@mail.example.com, {card} or +1 (555) 010-9999 {prose(r, 40)}", "10.0.0.256 10.0.0.7",
              "4465758382889437 4465758382889437 then 4465758382889437", "a@b @c.d e@f.g.h@i.j"]
    texts += ["Released under the MIT License.\n" + prose(r, 70), prose(r, 60) + "\nLicensed under CC BY-NC 4.0.\n"]
    out = [(i, t, "ab"[i % 2], [None, "s1", "s1", "s2"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "no id " * 30, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = defaultdict(list)
    for x in df.collect():
        found[x["doc_id"]].append(x)
    return found


# ------------------------------------------------------------------ 1 quality rules
def base_of(text):
    words = WORD.findall(text or "")
    runs = defaultdict(list)
    for i in range(len(words) - 2):
        runs[tuple(words[i:i + 3])].append(i)
    again = {p + k for at in runs.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(again))


def line_of(x):
    low = x.translate({c: c + 32 for c in range(65, 91)})
    return WHITE.sub(" ", re.sub("[0-9]+", "0", low)).strip(" \t\n\x0b\x0c\r")


def test_quality_rules_match_brute_force(docs, rows):
    options = {"max_docs": 2}
    got = by_id(line_quality.verdicts(docs, **options))
    assert sum(map(len, got.values())) == len(rows)
    holders = defaultdict(set)
    for _, t, _, host, _ in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                holders[host, line_of(x)].add(t)
    common = {k for k, v in holders.items() if len(v) > 2}
    assert any("read more" in k[1] for k in common)
    for doc_id, t, _, host, _ in rows:
        base = base_of(t)
        gone = [x for x in (t or "").split("\n") if WORD.search(x) and (host, line_of(x)) in common]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        for x in got[doc_id]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base
            assert (x.base_failed, x.n_lines_removed, x.removed_words) == (failed, len(gone), lost)
            assert x.kept == (not failed and base[0] - lost >= 0.3 * base[0])


def test_quality_cleaning_takes_the_lines_out(docs):
    out = line_quality.cleaned(docs, max_docs=2)
    assert out.columns == docs.columns
    texts = [x.text for x in out.collect()]
    assert texts and not any("Read more" in t for t in texts)
    assert out.filter("n_chars <> length(text)").count() == 0


# ---------------------------------------------------------------------- 2 exact dedup
def check_copies(found, rows):
    groups = defaultdict(list)
    for x in rows:
        groups[WHITE.sub("", x[1] or "")].append(x)
    for norm, members in groups.items():
        keep = min(members, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))[0]
        for doc_id in {x[0] for x in members}:
            for x in found[doc_id]:
                assert (x.keep_id, x.group_size, x.kept) == (keep, len(members), doc_id == keep)
                assert x.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_matches_brute_force(docs, rows):
    check_copies(by_id(chunk_dedup.duplicates(docs)), rows)


def test_exact_dedup_verifies_clashing_names(docs, rows):
    """With a name of 3 values nearly all chunks clash, and the ordinals tell them apart."""
    check_copies(by_id(chunk_dedup.duplicates(docs, name=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))), rows)


def test_chunks_cover_the_text(spark):
    text = prose(random.Random(2), 5000) + "x" * 20_000
    df = spark.createDataFrame([(text,)], "t string").select(
        chunk_dedup.normalised(F.col("t")).alias("n")).select("n", chunk_dedup.chunks(F.col("n")).alias("c"))
    x = df.first()
    assert "".join(x.c) == x.n and max(map(len, x.c)) <= chunk_dedup.MAX_CHUNK + 2 and len(x.c) > 20


# ------------------------------------------------------------------------- 3 licences
def test_license_lines_and_inheritance(spark):
    r = random.Random(4)
    rows = [(1, "a/b/1", "Released under the MIT License.\n" + prose(r, 50)), (2, "a/b/c/2", prose(r, 50)),
            (3, "a/3", prose(r, 40) + "\nThis work is licensed under the GNU General Public License, version 3.\nend"),
            (4, "a/b/c/d/4", "Licensed under CC BY-NC 4.0."), (5, "a/b/c/d/5", None), (6, "z", ""), (7, None, prose(r, 9)),
            (8, "a/x/8", "the license of this is not the public one under which it is known"), (8, "a/x/8", "again")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("line", F.lit(1))
    got = {x.doc_id: x for x in license_scan.scan(df, F.col("path"), F.col("first_line") == 0).collect()}
    assert [got[i].own_licence for i in (1, 2, 3, 4, 5, 8)] == ["MIT", None, "GPL-3.0", "CC-BY-NC-4.0", None, None]
    assert [got[i].licence for i in (2, 5, 6, 7, 8)] == ["MIT", "CC-BY-NC-4.0", None, None, None]
    assert got[2].inherited_from == "a/b" and got[5].inherited_from == "a/b/c/d" and got[3].inherited_licence is None


def test_license_scores_are_cosines(spark):
    lines = ["Released under the MIT License.", "Released again under the MIT License by me", "under the MIT tree"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "rid long, text string")
    got = {x.rid: x.score for x in license_scan.notices(df, threshold=0.3).filter("licence = 'MIT'").collect()}
    vec = lambda t: Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))
    seen = Counter(t for x in lines for t in vec(x))
    idf = lambda t: math.log((1 + len(lines)) / (1 + seen[t])) + 1
    for i, x in enumerate(lines):
        best = 0
        for name, text in license_scan.TEMPLATES:
            a, b = ({t: n * idf(t) for t, n in vec(y).items()} for y in (x, text))
            dot = sum(a[t] * b[t] for t in a if t in b)
            norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            best = max(best, dot / norm if name == "MIT" else 0)
        assert got.get(i, 0) == pytest.approx(best, abs=1e-5) or best < 0.3


# ------------------------------------------------------------------------ 4 near-dedup
def groups_of(rows, width):
    sets = {}
    for doc_id, t, *_ in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        n = min(width, len(words))
        sets[doc_id] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_matches_brute_force(docs, rows, width):
    sets, groups = groups_of(rows, width)
    assert len(set(groups.values())) < len(groups) - 8
    got = by_id(minhash_bayes.linked(docs, width=width))
    for doc_id, found in got.items():
        for x in found:
            assert x.n_shingles == len(sets[doc_id])
            assert x.component_id == (None if doc_id is None else groups[doc_id])
            assert x.kept == (x.component_id == doc_id)


def test_pivot_rounds_find_links_that_the_first_pivot_misses(spark):
    """A bucket whose first pivot is far from two members that are close to each other."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]

    def edited(words, n):
        words = list(words)
        for i in r.sample(range(60), n):
            words[i] = f"x{r.random()}"
        return words

    far = edited(base, 14)
    rows = [(1, " ".join(base))] + [(10 + i, " ".join(edited(far, 1))) for i in range(6)]
    rows += [(30 + i, " ".join(edited(base, 2))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, groups = groups_of(rows, 2)
    got = {x.doc_id: x.component_id for x in minhash_bayes.linked(df).collect()}
    assert got == groups and len(set(groups.values())) >= 2


def test_posterior_bounds():
    """The bound is the posterior's: integrate the density of the uniform prior."""
    t = np.linspace(0, 1, 200_001)
    for n in (16, 64):
        m = minhash_bayes.least_matches(n)
        for k, least in ((m - 1, False), (m, True)):
            density = t ** k * (1 - t) ** (n - k)
            above = density[t >= 0.8].sum() / density.sum()
            assert (above >= minhash_bayes.MISS * 0.99) == least


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 540)] + [(7, 539)]
    got = {x.a: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(500, 540)}}


# ------------------------------------------------------------------------------ 5 mix
def level_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(docs, rows):
    options = {"block": 16, "shard_slots": 64}
    found = by_id(mixing.mix(docs, **options))
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += len(WORD.findall(x[1] or ""))
    want, taken = level_targets(sizes), Counter()
    for doc_id, _, _, source, _ in {(x[0], None, None, x[3], None) for x in rows}:
        for x in found[doc_id]:
            assert x.source_size == sizes[source] and x.target == pytest.approx(want[source])
            assert 0 <= x.taken <= 2 * x["size"]
            taken[source] += x.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.1)
    again = by_id(mixing.mix(docs.repartition(3, "lang"), **options))
    assert {k: sorted(x.taken for x in v) for k, v in again.items()} == {k: sorted(x.taken for x in v) for k, v in found.items()}


def test_mixed_texts_are_the_words_taken(docs, rows):
    texts = {x[0]: WORD.findall(x[1] or "") for x in rows}
    pieces = by_id(mixing.mix(docs))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for doc_id, found in by_id(out).items():
        want = [w for k in (1, 2) for p in pieces[doc_id][0].pieces if p.times >= k
                for w in texts[doc_id][p.word:p.word + p.n]]
        if len(found) == 1:
            assert WORD.findall(found[0].text) == want


@pytest.mark.parametrize("n", [1, 2, 3, 37, 64, 1000])
def test_index_permutation(spark, n):
    df = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k)).alias(f"p{k}") for k in range(2)])
    got = df.collect()
    assert sorted(x.p0 for x in got) == sorted(x.p1 for x in got) == list(range(n))
    assert n < 37 or [x.p0 for x in got] != [x.p1 for x in got]


# -------------------------------------------------------------------------- 6 secrets
def secrets_in(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_match_brute_force(docs, rows):
    got = by_id(secret_scan.digest(secret_scan.scan(docs)))
    names = secret_scan.BASE
    for doc_id, t, *_ in rows:
        want = secrets_in(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        for x in got[doc_id]:
            assert [x.n_assign, x.n_access, x.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
            assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert set(filter(None, text.split(","))) <= set(x.spans.split(","))


def test_secret_owners_tell_examples_from_live(spark):
    wide, own, mix = "deadbeef" * 5, "0123abcd" * 5, "aB3dE5gH7jK9mN1pQ3sT5"
    rows = [(i, f"é {wide} {mix if i == 3 else ''}", f"o{i}", "r") for i in range(4)] + [
        (9, own, "o1", "r1"), (10, own, "o1", "r2"), (11, "x " + mix.swapcase(), "o1", None), (12, mix.swapcase(), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x.found for x in secret_scan.scan(df).collect()}
    assert got[0][0].verdict == "example" and got[0][0].owners == 4 and (got[0][0].start, got[0][0].end) == (2, 42)
    assert got[9][0].verdict == "live" and got[9][0].repos == 2
    assert [x.kind for x in got[3]] == ["hex", "owned"]
    assert got[11] == [] and got[12] == []  # two owners: neither a base span nor owner-specific


# ------------------------------------------------------------------- 7 context mixing
def test_scores_base_and_probability(docs, rows):
    got = by_id(context_mixing.score(docs, group="lang"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = [(x[0], context_mixing.tokens(x[1])) for x in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for doc_id, ws in toks:
        for x in got[doc_id]:
            assert (x.held_out, x.train_tokens) == (held(doc_id), n)
            assert x.n_tokens in {len(w) for i, w in toks if i == doc_id}
            assert -1e6 < x.score < 0
    for doc_id, ws in toks:
        if len(got[doc_id]) == 1:
            x = got[doc_id][0]
            assert x.n_known == sum(c[w] > 0 for w in ws)
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))


def test_spelling_is_a_distribution():
    """Over all bytes that may follow, the chances of the 8 bits add up to one; and learning
    helps held-out words."""
    r = random.Random(1)
    words = [w.encode() for w in {x for _ in range(60) for x in prose(r, 200).split()}]
    known, new = words[::2], words[1::2]
    counts = np.zeros((len(context_mixing.ORDERS), context_mixing.SLOTS, 2), np.float32)
    s = context_mixing.Spelled(known)
    for o in range(len(context_mixing.ORDERS)):
        for k in range(8):
            np.add.at(counts[o], (s.slots(o, k), s.bit(k)), s.times)
    mixer = context_mixing.fit_mixer(known, counts)
    plain = context_mixing.spelling(new, np.zeros_like(counts), context_mixing.Mixer())
    assert context_mixing.spelling(new, counts, mixer).sum() > 0.6 * plain.sum() / 1.0
    total = 0.0
    for byte in range(256):  # the first byte, whatever follows: leave the closing byte's cost out
        one = context_mixing.Spelled([bytes([byte])])
        first = np.flatnonzero(one.case == np.uint64(byte))[:1]
        p = 1.0
        for k in range(8):
            at = [one.slots(o, k)[first] for o in range(len(context_mixing.ORDERS))]
            c = np.stack([counts[o, a] for o, a in enumerate(at)], axis=1)
            x, gate = mixer.inputs(c[..., 0], c[..., 1], k)
            q = mixer.combine(x, gate)[1][0]
            p *= q if (byte >> (7 - k)) & 1 else 1 - q
        total += p
    assert total == pytest.approx(1.0)


def test_held_out_text_of_a_group_scores_better_than_the_base(spark):
    r = random.Random(5)
    letters = ["abcdef", "ghijkl", "mnopqr"]
    vocabulary = [["".join(r.choice(x) for _ in range(4)) for _ in range(300)] for x in letters]
    rows = [(i, " ".join(r.choice(vocabulary[i % 3]) for _ in range(80)), "xyz"[i % 3]) for i in range(210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x = context_mixing.score(df, group="lang").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert x[0] > x[1]


def test_mixer_and_shares_are_learned_from_all_words(spark, monkeypatch):
    """Every learned word takes part: as many bits are counted as the words have, and the shares
    are those of all occurrences; in one part, the weights are those of all words in turn."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    rows = [(i, " ".join(vocabulary[i * 100:(i + 1) * 100] + r.choices(vocabulary[:50], k=20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    mixers, shares = context_mixing.learned_mixer, context_mixing.learned_shares

    def mixer(words, counts):
        seen.update(words=words.select("word", "learned").collect(), counts=counts.value, mixer=mixers(words, counts))
        return seen["mixer"]

    monkeypatch.setattr(context_mixing, "learned_mixer", mixer)
    monkeypatch.setattr(context_mixing, "learned_shares", lambda *a: seen.setdefault("shares", shares(*a)))
    context_mixing.score(df)
    words = [bytes(x["word"]) for x in seen["words"]]
    assert len(words) > 20_000
    added = seen["mixer"].hits.sum() - context_mixing.Mixer().hits.sum()
    assert added == pytest.approx(8 * sum(len(w) + 1 for w in words))
    one = context_mixing.fit_mixer(sorted(words), seen["counts"])
    assert np.allclose(seen["mixer"].weights[one.seen > 0], one.weights[one.seen > 0])
    c = np.array([sum(x["learned"]) for x in seen["words"]], float)
    spelled = 10 ** context_mixing.spelling(words, seen["counts"], seen["mixer"], True)
    n = c.sum() + sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)  # with the ends
    want = context_mixing.fit_share(np.maximum(c - 1, 0) / (n - 1) / spelled, c)
    assert seen["shares"][0] == pytest.approx(want, rel=0.01) and 0 < want < 1


def test_words_before_take_part_in_the_score(spark):
    """The order of the words counts, and a text that occurs twice is told apart."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    after = {w: r.sample(vocabulary, 3) for w in vocabulary}

    def text(n):
        out = [r.choice(vocabulary)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]) if r.random() < 0.9 else r.choice(vocabulary))
        return out

    texts = [text(100) for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(r.sample(t, len(t)))) for i, t in enumerate(texts[:20])]
    rows += [(2000 + i, " ".join(t)) for i, t in enumerate(texts[20:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in context_mixing.score(df).collect()}
    held = [got[1000 + i]["held_out"] or got[i]["held_out"] for i in range(20)]
    for i in range(20):
        if not held[i]:
            assert got[1000 + i]["base_score"] == pytest.approx(got[i]["base_score"])
            assert got[1000 + i]["score"] < 1.3 * got[i]["score"] < 0
    once = min(got[i]["bits_per_byte"] for i in range(30, 300) if not got[i]["held_out"])
    twice = [got[i]["bits_per_byte"] for i in range(20, 30) if not (got[i]["held_out"] or got[1980 + i]["held_out"])]
    assert len(twice) > 3 and max(twice) < once


def test_scores_match_brute_force(spark, docs, rows, monkeypatch):
    """Counts of words, pairs and triples by dictionary, each occurrence of a learned document left
    out of its contexts; many parts and several pieces."""
    monkeypatch.setattr(word_contexts, "PART_TOKENS", 1000)
    monkeypatch.setattr(word_contexts, "TASK_TOKENS", 2000)
    seen = {}

    def held(name):
        f = getattr(context_mixing, name)

        def kept(first, second, *rest):
            seen[name] = f(first, second, *rest)
            seen["counts"] = getattr(second, "value", seen.get("counts"))
            return seen[name]

        monkeypatch.setattr(context_mixing, name, kept)

    for name in ("learned_mixer", "learned_shares", "learned_contexts"):
        held(name)
    got = by_id(context_mixing.score(docs, group="lang"))
    weights, shares, size = seen["learned_contexts"], seen["learned_shares"], context_mixing.SIZES
    assert np.allclose(weights.sum(axis=1), 1)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = [(x[0], x[2], [context_mixing.END, *context_mixing.tokens(x[1])]) for x in rows]
    learned = [(g, t) for i, g, t in toks if not out(i)]
    names = sorted(Counter(g for g, _ in learned), key=lambda g: (-sum(x == g for x, _ in learned), g is not None, g))
    c = [Counter(w for g, t in learned if g == name for w in t[1:]) for name in names] + [Counter()]
    n_of = [sum(x.values()) for x in c]
    word, pair, triple = Counter(), Counter(), Counter()
    for _, t in learned:
        word.update(t[1:])
        pair.update(zip(t, t[1:]))
        triple.update(zip(t, t[1:], t[2:]))
    every = sorted({w for _, _, t in toks for w in t})
    spelled = dict(zip(every, 10 ** context_mixing.spelling(every, seen["counts"], seen["learned_mixer"])))
    gates = set()
    for i, _, t in toks:
        own, logs = int(not out(i)), [math.log((n + 1) / (sum(n_of) + len(c))) for n in n_of]
        for k in range(1, len(t)):
            u, v, w = t[k - 2] if k > 1 else None, t[k - 1], t[k]
            one, two = word[v] - own, pair[u, v] - own if k > 1 else 0
            parts = [(pair[v, w] - own) / one if one else 0, (triple[u, v, w] - own) / two if k > 1 and two else 0]
            gates.add((one.bit_length(), two.bit_length()))
            a = weights[one.bit_length() * size + two.bit_length()]
            for g, x in enumerate(c):
                alone = shares[g] * x[w] / max(n_of[g], 1) + (1 - shares[g]) * spelled[w]
                logs[g] += math.log(a[0] * alone + a[1] * parts[0] + a[2] * parts[1])
        want = (max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))) / math.log(10)
        assert any(x["score"] == pytest.approx(want, rel=1e-5) for x in got[i]), (i, len(t), want, got[i])
    assert len(gates) > 20


def test_word_keys_are_exact():
    """Keys go through their packed form unchanged, a part holds its own, and words of any bytes
    and lengths differ."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    words = sorted({r.bytes(n) for n in r.integers(1, 9, 20_000)} | {b"x" * n for n in (1, 255, 256, 257, 5000)})
    h = word_contexts.hashes(pa.array(words, pa.binary()))
    assert len(set(h.tolist())) == len(words)
    assert (word_contexts.hashes(pa.array(words[::-1], pa.binary()).slice(3, 500)) == h[::-1][3:503]).all()
    for tokens in (0, 1, 100, 1 << 20, 1 << 25, 1 << 40):
        deal = word_contexts.Deal(tokens)
        for context in range(word_contexts.CONTEXTS):
            keys = np.unique(deal.key(context, h))
            parts = list(deal.dealt(context, keys))
            assert len({p for p, _, _ in parts}) == len(parts) and max(p for p, _, _ in parts) < deal.parts
            assert (np.concatenate([deal.keys(context, p, data) for p, _, data in parts]) == keys).all()
    for x in ([], [0], [0] * 9, [255, 256, 1 << 63]):
        assert word_contexts.unpack(word_contexts.pack(np.array(x, np.uint64))).tolist() == x


def test_learning_works_out_each_case_once(monkeypatch):
    """The inputs of a run of learning steps are worked out once per distinct case, and the
    weights and cells are those of learning bit by bit from each step's own counts."""
    r = random.Random(13)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 8))).encode() for _ in range(6_000)})
    s = context_mixing.Spelled(words)
    counts = np.zeros((len(context_mixing.ORDERS), context_mixing.SLOTS, 2), np.float32)
    for o in range(len(context_mixing.ORDERS)):
        for k in range(8):
            np.add.at(counts[o], (s.slots(o, k), s.bit(k)), s.times)
    want, order = context_mixing.Mixer(), np.random.default_rng(7)
    for _ in range(context_mixing.PASSES):
        turn = order.permutation(len(words))
        for i in range(0, len(turn), 512):
            step = context_mixing.Spelled([words[j] for j in turn[i:i + 512]])
            for k in range(8):
                bit = step.bit(k)
                c = np.stack([counts[o, step.slots(o, k)] for o in range(len(context_mixing.ORDERS))], axis=1)
                c = np.maximum(c - np.stack([1 - bit, bit], axis=1)[:, None, :], 0)
                x, gate = want.inputs(c[..., 0], c[..., 1], k)
                p, _, cell = want.combine(x, gate)
                off, n = (bit - p) * step.times, np.bincount(gate, step.times, len(want.weights))
                total = np.zeros(want.weights.shape)
                np.add.at(total, gate, off[:, None] * x)
                want.weights += context_mixing.RATE * total / np.sqrt(np.maximum(n, 1))[:, None]
                want.count(gate, bit, cell, step.times)
    hashed, mixed = [], context_mixing._mixed
    monkeypatch.setattr(context_mixing, "_mixed", lambda x: hashed.append(len(x)) or mixed(x))
    got = context_mixing.fit_mixer(words, counts)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.hits, want.hits)
    contexts = len(context_mixing.ORDERS)
    assert sum(hashed) <= context_mixing.PASSES * 9 * contexts * len(s.case)
    monkeypatch.setattr(context_mixing, "HELD_BYTES", 1)  # as for very long words: every step alone, in blocks
    monkeypatch.setattr(context_mixing, "BLOCK", 100)
    got = context_mixing.fit_mixer(words, counts)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.hits, want.hits)


def test_words_are_split_counted_and_added_up_by_column(spark, monkeypatch):
    """The words of a column of texts are those of each text, without work in Python for each
    of them; pieces and batches do not change counts and sums."""
    import pyarrow as pa

    r = random.Random(21)
    odd = [None, "", " ", "\t a\x0bb\x1cc\x85d\u2003É \n", "x" * 70 + " y " + "x" * 70, "Ab aB ÀB\r\nab", "é" * 40 + " "]
    texts = odd + [prose(r, r.randint(0, 60)) + r.choice(["", " ", "\n"]) for _ in range(300)]
    calls = []
    context_mixing.column_tokens(pa.array(odd))  # imports
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        words, rows = context_mixing.column_tokens(pa.array(texts))
    finally:
        sys.setprofile(None)
    assert len(calls) < 250 < len(texts) < len(words)
    found = {i: [] for i in range(len(texts))}
    for w, i in zip(words.to_pylist(), rows.tolist()):
        found[i].append(w)
    assert [found[i] for i in range(len(texts))] == [context_mixing.tokens(t) for t in texts]
    words, rows = word_table.split(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in (t or "").encode().split()]
    monkeypatch.setattr(word_table, "PIECE_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "n"])
    parts = list(word_table.pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 3)]), 0))
    assert len(parts) > 20
    assert [x for p in parts for x in p.column(1).to_pylist()] == [*range(len(texts)), 5, 6, 7]

    df = spark.createDataFrame([(i, t, i % 4 - 1) for i, t in enumerate(texts * 2)], "id int, text string, g int").coalesce(2)
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(small, 7)
    try:
        counted = word_table.count_words(df, "text", context_mixing.column_tokens, F.col("g"), 3)
        got = {bytes(x.word): (x.total, x.learned) for x in counted.collect()}
        values = counted.select("word", "total", F.length("word").cast("double").alias("a"), F.lit(0.5).alias("b"))
        summed = word_table.add_up(df, "text", context_mixing.column_tokens, values, ["a", "b"], ["id"]).collect()
    finally:
        spark.conf.unset(small)
    want = [Counter(w for i, t in enumerate(texts * 2) if i % 4 == k for w in context_mixing.tokens(t)) for k in range(4)]
    assert got == {w: (sum(c[w] for c in want), [c[w] for c in want[1:]]) for w in set().union(*want)}
    each = [context_mixing.tokens(t) for t in texts * 2]
    assert sorted(tuple(x) for x in summed) == [(i, len(w), float(sum(map(len, w))), len(w) / 2) for i, w in enumerate(each)]


# ------------------------------------------------------------------------------ 8 PII
def pii_in(text):
    text, out = text or "", []
    for m in pii_crf.EMAIL.finditer(text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans(docs, rows):
    got = by_id(pii_crf.digest(pii_crf.scan(docs)))
    for doc_id, t, *_ in rows:
        want = pii_in(t)
        text = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in want)
        for x in got[doc_id]:
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
            assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mail_search_equals_the_pattern():
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice("ab@.. -%1é") for _ in range(r.randint(0, 30)))
        assert [m.span() for m in pii_crf.EMAIL.finditer(t)] == list(pii_crf._mails(t))


def test_skip_links_carry_labels(spark):
    """A card number run together with its copy matches no pattern; its other occurrence
    labels it, and without one nothing is added."""
    r = random.Random(6)
    n = "4465758382889437"
    rows = [(i, f"{prose(r, 30)} {n if i % 2 else '4111111111111111'} {prose(r, 30)}") for i in range(40)]
    rows += [(100, f"{prose(r, 20)} {n} {n} {prose(r, 60)} {n} {prose(r, 9)}"), (101, prose(r, 50) + " 1234 5 and 77")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii_crf.scan(df).collect()}
    extra = {i: [x for x in v if not x.base] for i, v in got.items()}
    assert [x.kind for x in extra[100]] == ["card", "card"] and not any(v for i, v in extra.items() if i != 100)


# -------------------------------------------------------------------------- 9 packing
def test_best_fit_equals_one_at_a_time():
    r = random.Random(9)
    for _ in range(200):
        cap = r.choice([7, 16, 50, 2048])
        lengths = [r.randint(1, cap) for _ in range(r.randint(0, 200))]
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [y for y in rooms if y >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else cap) - x)
        counts = Counter(lengths)
        runs, used = best_fit.best_fit_decreasing(counts, cap), defaultdict(list)
        for x, n in counts.items():
            own = [y for y in runs if y[0] == x]
            for k in range(n):
                run = max(y for y in own if y[1] <= k)
                d = k - run[1]
                used[run[2] + d // run[3]].append((run[4] + d % run[3] * x, x))
        for v in used.values():
            v.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:])) and v[0][0] == 0
        assert sorted(cap - sum(x for _, x in v) for v in used.values()) == sorted(rooms)


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    cap = 64
    out = best_fit.pack(docs, BPE, cap, keep_ids=True).collect()
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x, *_ in rows)
    by_doc = defaultdict(list)
    for x in out:
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
        by_doc[x.doc_id].append(x)
    for (i, ids), n in want.items():
        found = sorted((x.piece, x.start, tuple(x.ids)) for x in by_doc[i])
        cut = sorted((k, a, ids[a:b]) for k, (a, b) in enumerate(
            zip([0, *range(len(ids) % cap or cap, len(ids), cap)], [*range(len(ids) % cap or cap, len(ids) + 1, cap)])) for _ in range(n))
        assert found == cut
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= cap


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(BPE), token_ids.ids_of(BPE)
    r = random.Random(2)
    odd = ["", " ", "\n\n  x", "<|endoftext|> a <|endoftext|>", "don't I'LL", "日本語 текст   x", "🙂👍🏽", "a" * 3000, "\x00\x7f"]
    for s in odd + [prose(r, 200) for _ in range(5)] + [
            "".join(r.choice("aé 1.\n'sßЖ\t漢-") for _ in range(300)) for _ in range(30)]:
        assert ids(s) == t.encode(s, add_special_tokens=False).ids


# --------------------------------------------------------------------- 10 token counts
def best_split(word, scores):
    last, longest = -math.log(len(scores) + 2), max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        b = len(word[end - 1].encode())
        options = [(best[-1][0] + b * last, -(best[-1][1] + b))]
        options += [(best[i][0] + scores[word[i:end]], -(best[i][1] + 1))
                    for i in range(max(0, end - longest), end) if word[i:end] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1]


def test_trie_counts_match_each_word_alone(docs, rows):
    scores = trie_tokens.pieces(PIECES)
    got = by_id(trie_tokens.token_counts(docs, PIECES))
    for doc_id, t, *_ in rows:
        splits = [best_split(trie_tokens.MARK + w, scores) for w in WORD.findall(t or "")]
        if len(got[doc_id]) == 1:
            x = got[doc_id][0]
            assert (x.n_pretokens, x.n_tokens) == (len(splits), sum(n for _, n in splits))
            assert x.score == pytest.approx(sum(s for s, _ in splits))


def test_trie_shares_prefixes():
    trie = trie_tokens.Trie({"a": -1.0, "ab": -1.5, "b": -1.0})
    assert [trie.count(w) for w in ("ab", "aba", "abab", "b")] == [(-1.5, 1), (-2.5, 2), (-3.0, 2), (-1.0, 1)]
    assert trie.nodes == 5


# ----------------------------------------------------------------------- odd inputs
OPERATORS = {
    "quality": line_quality.verdicts, "clean": line_quality.cleaned, "copies": chunk_dedup.duplicates,
    "exact": chunk_dedup.deduplicated, "near": minhash_bayes.linked, "kept": minhash_bayes.representatives,
    "mix": mixing.mix, "mixed": mixing.mixed, "secrets": secret_scan.scan, "score": context_mixing.score,
    "pii": pii_crf.scan, "pack": lambda d: best_fit.pack(d, BPE), "trie": lambda d: trie_tokens.token_counts(d, PIECES),
    "licences": lambda d: license_scan.scan(d, F.col("source"), F.col("first_line") == 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_clashing_columns(spark, name):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "a", None, 0), (2, "", "a", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in CLASH])
    out = OPERATORS[name](df)
    out.collect()
    if set(out.columns) >= set(CLASH):
        assert out.columns == df.columns


def test_every_query_is_registered():
    assert {int(re.match(r"op(\d+)_", x)[1]) for x in registry.QUERIES} == set(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    from tests.oracle_check import compare

    assert compare(spark, "/root/testdata/sf0.001", [name], verbose=False)[name] == "OK"


# ---------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, docs, rows):
    """Each stage against brute force on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    as_rows = lambda df: [tuple(x) for x in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    at = spark.createDataFrame(sorted({x for x in rows if x[0] is not None}), SCHEMA)
    kept = as_rows(stages["quality rules"](spark, at, ""))
    assert {x[0] for x in kept} == {x[0] for x in as_rows(at) if base_of(x[1])[0] >= 50
                                    and 2 * base_of(x[1])[4] <= base_of(x[1])[0]}
    at = spark.createDataFrame(kept, SCHEMA)
    one = as_rows(stages["exact dedup"](spark, at, ""))
    texts = defaultdict(list)
    for x in kept:
        texts[WHITE.sub("", x[1])].append(x)
    assert {x[0] for x in one} == {min(v, key=lambda x: (-len(x[1]), x[0]))[0] for v in texts.values()}
    at = spark.createDataFrame(one, SCHEMA)
    near = as_rows(stages["near-dedup"](spark, at, ""))
    _, groups = groups_of(one, corpus_pipeline.NEAR_WIDTH)
    assert {x[0] for x in near} == set(groups.values()) and len(near) < len(one)
    at = spark.createDataFrame(near, SCHEMA)
    mix = stages["source mix"](spark, at, "")
    assert mix.columns == at.columns and mix.count() > 0
    packed = stages["packing"](spark, mix, "")
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in mix.collect()}


def test_stages_go_by_row(spark):
    """Repeated rows, one id with several texts, and null ids: each row has its own decision."""
    r = random.Random(4)
    a, b, c, d = (prose(r, 200) for _ in range(4))
    near = a.replace(a.split()[50], "changed", 1)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (None, near), (3, near + " "),
            (3, "few words"), (None, "few words")]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: Counter((x.doc_id, x.text) for x in df.collect())
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert ids(stages["quality rules"](spark, frame(rows), "")) == Counter(x[:2] for x in rows if base_of(x[1])[0] >= 50)
    assert ids(stages["exact dedup"](spark, frame(rows), "")) == Counter(
        [(1, a), (1, b), (None, c), (3, near + " "), (3, "few words")])
    assert ids(stages["near-dedup"](spark, frame(rows), "")) == Counter([(1, a), (1, b), (None, c), (3, "few words")])
    # The mix's plan and its texts agree, row by row.
    twice = [(7, a, "en", "s", None), (7, a, "en", "s", None), (7, b, "en", "s", None), (None, c, "en", "t", None),
             (None, d, "en", "t", None)]
    at = frame(twice).cache()
    at.count()
    taken = Counter((x.doc_id, x.taken) for x in mixing.mix(at).collect() if x.taken)
    assert Counter((x.doc_id, len(WORD.findall(x.text))) for x in stages["source mix"](spark, at, "").collect()) == taken


def test_row_keys_are_unique_and_stand(spark, docs, tmp_path):
    """Rows of files, of files read twice, of nothing, and rows that no file holds."""
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "t"))
    path = str(tmp_path / "t")
    at = spark.read.parquet(path)
    assert common._placed(at) is not None and common._placed(at.union(at)) is None and common._placed(docs) is None
    for df in (at, spark.read.parquet(path, path), at.union(at), docs, at.filter("doc_id > 3")):
        size = df.count()
        rows = common.keyed(df)
        texts = {x["_row"]: x["t"] for x in rows.select("_row", F.col("_doc.text").alias("t")).collect()}
        again = {x["_row"]: x["_doc"]["text"] for x in rows.repartition(3).collect()}
        assert len(texts) == size and texts == again


def test_pipeline_runs_on_a_table(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
