"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocknames, bytepairs, chaining, credentials, hardnegatives, kdsearch, ordinal, packing, prefixtrie, setjoin, sitebayes, urlmodel, wordbpe
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.scored(docs, model).select(
        "doc_id", F.col("__severity").alias("expected_severity"), F.col("__grade").alias("grade"), ordinal.is_toxic(model).alias("toxic")
    )


@query
def op2_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocknames.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_duplicates"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


@query
def op4_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


RULES = [
    urlmodel.Rule("allow", "org", "/"),
    urlmodel.Rule("block", "example.org", "/es/"),
    urlmodel.Rule("block", "example.org", "/en/1"),
    urlmodel.Rule("allow", "com", "/fr/"),
    urlmodel.Rule("block", "com", "/de/"),
]


@query
def op5_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judged(table(spark, sf_dir, "pages"), RULES)


@query
def op6_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdsearch.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op6_kd_tree_top_k"] = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sitebayes.quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


@query
def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bytepairs.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op11_vertical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=label)


ORACLES["op11_vertical_scan"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query
def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = wordbpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.ordered_turns(table(spark, sf_dir, "conversations"))))


ORACLES["op13_prefix_rollup"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_id) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda s, x: list_reduce(list_concat([xor(s, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
  FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT m.conv_id, t.pos, t.turn_id, strlen(t.text) AS bytes FROM m JOIN t ON t.conv_id = m.base AND t.pos <= m.h
  UNION ALL SELECT m.conv_id, t.pos - m.h + m.k, t.turn_id, strlen(t.text) FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos > m.h),
p AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS bytes FROM c
  UNION ALL SELECT conv_id, pos, sha256(string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY pos)), bytes FROM r),
q AS (SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
g AS (SELECT node, depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (node)),
pairs AS (SELECT DISTINCT v.node AS top, u.node FROM q v JOIN q u ON u.conv_id = v.conv_id AND u.depth >= v.depth),
s AS (SELECT top AS node, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM pairs JOIN f USING (node) GROUP BY top)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN f u ON u.node = f.up"""
