"""The registered corpus queries, op<N>_<name>, with their production parameters, and the
DuckDB SQL that recomputes them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit, chunk_dedup, context_mixing, filter_audit, learned_partitions, lexical_search, license_scan,
    line_quality, minhash_bayes, mixing, pii_crf, secret_scan, trie_tokens,
)
from .common import documents, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
wl AS (SELECT doc_id, host, t, l, len(regexp_extract_all(l, '{WORD}')) AS n,
         trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
       FROM ln WHERE regexp_matches(l, '{WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM wl GROUP BY doc_id),
freq AS (SELECT host, k, count(DISTINCT t) AS docs FROM wl GROUP BY host, k),
common AS (SELECT host, k FROM freq WHERE docs > 8),
gone AS (SELECT wl.doc_id, count(*) AS n_lines_removed, sum(n) AS removed_words
         FROM wl JOIN common c ON wl.host IS NOT DISTINCT FROM c.host AND wl.k = c.k GROUP BY wl.doc_id),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
        CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 10 * (n_words - removed_words) >= 3 * n_words AS kept
FROM s
"""


@query("op1_line_quality", OP1_SQL)
def op1(spark, sf_dir):
    return line_quality.verdicts(documents(spark, sf_dir, "doc_id", "source", "text")).drop(
        "removed_lines")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


@query("op2_chunk_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return chunk_dedup.duplicates(documents(spark, sf_dir, "doc_id", "text")).drop("n_chunks")


@query("op5_source_mix")
def op5(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text")).drop("pieces")


def _op6_kind(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, owner, repo, {no} AS kn, '{kind}' AS kind, vs[i] AS v,
  list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s,
  length(ms[i]) AS n
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, owner, repo, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs,
    string_split_regex(t, '{p}') AS ps FROM d))
WHERE length(vs[i]) >= {least}"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repo
           FROM documents),
hits AS ({" UNION ALL ".join(_op6_kind(no, *kind) for no, kind in enumerate(secret_scan.KINDS))}),
good AS (SELECT *, s + n AS e FROM hits WHERE kn < 3 OR (regexp_matches(v, '[0-9]')
         AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))),
own AS (SELECT v, count(DISTINCT owner) AS owners FROM good GROUP BY v),
j AS (SELECT good.*, owners FROM good JOIN own USING (v)),
keep AS (SELECT * FROM j WHERE kn < 3 OR (owners = 1 AND NOT EXISTS (
         SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.kn < 3 AND b.s < j.e AND j.s < b.e))),
per AS (SELECT doc_id, count(*) FILTER (kn = 0) AS n_assign, count(*) FILTER (kn = 1) AS n_access,
          count(*) FILTER (kn = 2) AS n_hex, count(*) FILTER (owners = 1) AS n_live,
          count(*) FILTER (owners >= 3) AS n_example,
          string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kn) AS spans,
          string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kn)
            FILTER (kn < 3) AS base FROM keep GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN per USING (doc_id)
"""


@query("op6_secret_owners", OP6_SQL)
def op6(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir, "doc_id", "text", "source", "lang")))


@query("op9_best_fit_pack")
def op9(spark, sf_dir):
    return best_fit.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


@query("op4_minhash_bayes")
def op4(spark, sf_dir):
    return minhash_bayes.linked(documents(spark, sf_dir, "doc_id", "text"))


@query("op7_context_mixing")
def op7(spark, sf_dir):
    return context_mixing.score(documents(spark, sf_dir, "doc_id", "text", "lang"), group="lang")


@query("op10_trie_tokens")
def op10(spark, sf_dir):
    return trie_tokens.token_counts(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


@query("op8_skip_chain_pii")
def op8(spark, sf_dir):
    return pii_crf.digest(pii_crf.scan(documents(spark, sf_dir, "doc_id", "text")))


def _op3_templates() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
                     for i, (name, text) in enumerate(license_scan.TEMPLATES))
    return f"(VALUES {rows}) AS t(template, licence, text)"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' ||
             CAST(doc_id // 50 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(
         regexp_extract_all(lower(t), '[a-z0-9]+(?:\.[0-9]+)*'))) AS term FROM d) GROUP BY term),
tv AS (SELECT template, licence, term, count(*) * (ln((1.0 + max(n.n)) / (1.0 + coalesce(max(df.df), 0))) + 1) AS w
       FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)*')) AS term
             FROM {_op3_templates()}) LEFT JOIN df USING (term), n GROUP BY 1, 2, 3),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM d),
lv AS (SELECT doc_id, line, term, count(*) * (ln((1.0 + max(n.n)) / (1.0 + max(df.df))) + 1) AS w
       FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(l), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM l)
       JOIN df USING (term), n GROUP BY 1, 2, 3),
ln AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM lv GROUP BY 1, 2),
dot AS (SELECT doc_id, line, template, licence, sum(lv.w * tv.w) AS dot FROM lv JOIN tv USING (term) GROUP BY 1, 2, 3, 4),
sc AS (SELECT doc_id, line, licence, round(dot / (ln.norm * tn.norm), 6) AS score FROM dot
       JOIN ln USING (doc_id, line) JOIN tn USING (template)),
note AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, licence) AS rn
         FROM sc WHERE score >= 0.7) WHERE rn = 1),
own AS (SELECT doc_id, first(licence ORDER BY score DESC, licence) AS own_licence, max(score) AS own_score,
          count(*) AS n_notices, min(line) AS first_line FROM note GROUP BY doc_id),
a AS (SELECT d.doc_id, path, own_licence, own_score, coalesce(n_notices, 0) AS n_notices, first_line,
        regexp_replace(path, '/[^/]*$', '') AS dir FROM d LEFT JOIN own USING (doc_id)),
file AS (SELECT dir, first(own_licence ORDER BY own_score DESC, doc_id) AS licence FROM a
         WHERE first_line = 0 AND own_licence IS NOT NULL GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM a),
up AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS above
       FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM dirs)),
near AS (SELECT up.dir, first(licence ORDER BY k DESC) AS inherited_licence, first(above ORDER BY k DESC) AS inherited_from
         FROM up JOIN file ON up.above = file.dir GROUP BY up.dir)
SELECT doc_id, path, own_licence, own_score, n_notices, inherited_licence, inherited_from,
  coalesce(own_licence, inherited_licence) AS licence FROM a LEFT JOIN near USING (dir)
"""


@query("op3_license_paths", OP3_SQL)
def op3(spark, sf_dir):
    """The documents have no path: it is derived as source/<id div 1000>/<id div 50>/<id>; a
    document that opens with a notice is its directory's licence file."""
    part = lambda n: F.expr(f"doc_id div {n}").cast("string")
    path = F.concat_ws("/", "source", part(1000), part(50), F.col("doc_id").cast("string"))
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return license_scan.scan(docs, path, F.col("first_line") == 0)


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
        FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
        len(ws) < 50,
        100 * len(list_distinct(ws)) < 65 * len(ws),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM d LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT seq, array_to_string(list_transform(seq, lambda i: 'ABCDE'[i]), '') AS filter_order,
        unnest([1, 2, 3, 4, 5]) AS step FROM o),
c AS (SELECT part, filter_order, step, seq[step] AS f, n, good, toxic, fails[seq[step]] AS now,
        len(list_filter(seq[1:step - 1], lambda i: fails[i])) > 0 AS earlier,
        len(list_filter([1, 2, 3, 4, 5], lambda i: fails[i])) AS n_failed
      FROM g, s),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT now AND NOT earlier) AS kept,
        sum(n) FILTER (now AND NOT earlier) AS removed, sum(n) FILTER (now AND earlier) AS redundant,
        sum(n) FILTER (now AND n_failed = 1) AS unique_fails, sum(good) FILTER (now AND NOT earlier) AS good_lost,
        sum(toxic) FILTER (now AND NOT earlier) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_postings", OP12_SQL)
def op12(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "source", "text"), table(spark, sf_dir, "labels"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {OP11_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
it AS (SELECT DISTINCT item_id, unnest({OP11_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
sc AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
       FROM it JOIN tf USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
WHERE rank <= 50
"""


@query("op11_shared_terms", OP11_SQL)
def op11(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_learned_partitions")
def op13(spark, sf_dir):
    return learned_partitions.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"),
                                     lambda i: F.pmod(i, F.lit(50)) == 0)
