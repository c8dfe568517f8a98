"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import read
from .decontaminate import op3_decontaminate
from .divergence import op11_divergence
from .embeddings import op4_embeddings
from .packing import op9_packing
from .pii import op7_pii
from .prefixes import op12_prefixes
from .quality import op1_quality
from .secrets import op10_secrets
from .sharding import op13_sharding
from .simhash import op2_simhash
from .suffixes import op6_suffixes
from .tokencounts import op5_token_counts
from .toxicity import op8_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda f: lambda s, d: f(read(s, d, "documents"))
    both = lambda f, t: lambda s, d: f(read(s, d, "documents"), read(s, d, t))
    return {
        "op1_quality": both(op1_quality, "labels"),
        "op2_simhash": docs(op2_simhash),
        "op3_decontaminate": both(op3_decontaminate, "benchmark"),
        "op4_embeddings": lambda s, d: op4_embeddings(read(s, d, "embeddings")),
        "op5_token_counts": docs(op5_token_counts),
        "op6_suffixes": docs(op6_suffixes),
        "op7_pii": docs(op7_pii),
        "op8_toxicity": both(op8_toxicity, "labels"),
        "op9_packing": docs(op9_packing),
        "op10_secrets": docs(op10_secrets),
        "op11_divergence": docs(op11_divergence),
        "op12_prefixes": lambda s, d: op12_prefixes(read(s, d, "conversations")),
        "op13_sharding": docs(op13_sharding),
        "pipeline": corpus_pipeline.run,
    }


DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, w[pos:pos + 9] AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM b WHERE len(w) > 0)
), k AS (SELECT gram, array_to_string(gram, ' ') AS g, len(gram) AS n, list(item) AS items FROM g GROUP BY gram),
n AS (SELECT DISTINCT n FROM k),
t AS (
  SELECT doc_id, pos, n.n, array_to_string(w[pos:pos + n.n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d), n WHERE pos + n.n - 1 <= len(w)
), h AS (SELECT doc_id, pos, t.n, items FROM t JOIN k USING (g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM (SELECT doc_id, unnest(items) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS all_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, term, 1 + (1000000000 * (k.total + 1)) // (all_total + v) AS q FROM k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: crc32 of the decimal conv_id is taken bit by bit.
PREFIXES = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda acc, c: list_reduce(list_prepend(xor(acc, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT)) % 6 AS h FROM o GROUP BY conv_id
), k AS (SELECT s.conv_id, h, n, count(o.pos) AS k FROM s LEFT JOIN o ON o.conv_id = s.base AND o.pos <= h GROUP BY ALL),
r AS (
  SELECT s.conv_id, o.pos AS d, role, text FROM s JOIN o ON o.conv_id = s.base AND o.pos <= h
  UNION ALL SELECT k.conv_id, k + pos - h, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND pos > h
), p AS (
  SELECT conv_id, d, length(text) AS tokens, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS seq FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM k
), l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
m AS (SELECT min(conv_id) OVER (PARTITION BY seq) AS owner, p.conv_id, d, tokens, len, seq FROM p JOIN l USING (conv_id)),
n AS (
  SELECT owner, d, any_value(tokens) AS tokens, count(*) AS members, any_value(seq) AS seq, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '')) AS ends_sha256
  FROM m GROUP BY owner, d
), c AS (
  SELECT c.owner, c.d, p.owner AS parent FROM n c JOIN n p ON p.d = c.d - 1 AND p.seq = c.seq[1:c.d - 1]
), f AS (SELECT parent AS owner, d - 1 AS d, count(*) AS n FROM c GROUP BY ALL),
up AS (  -- each node with those that it lies below, itself included: by its owner's path
  SELECT n.owner, n.d, n.tokens, n.members, a.owner AS top, a.d AS top_d FROM n JOIN m a ON a.conv_id = n.owner AND a.d <= n.d
), g AS (
  SELECT top, top_d, sum((members - 1) * up.tokens) AS saved, count(*) FILTER (f.n IS NULL) AS leaves FROM up LEFT JOIN f USING (owner, d) GROUP BY ALL
)
SELECT n.owner AS conv_id, CAST(n.d AS BIGINT) AS depth, parent AS parent_conv_id, members AS n_convs, coalesce(f.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n LEFT JOIN c USING (owner, d) LEFT JOIN f ON f.owner = n.owner AND f.d = n.d JOIN g ON g.top = n.owner AND g.top_d = n.d
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; the others are tested against brute force in tests/llm."""
    found = {"op3_decontaminate": DECONTAMINATE, "op11_divergence": DIVERGENCE, "op12_prefixes": PREFIXES}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
