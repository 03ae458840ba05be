"""Registered queries of the operators in this folder, with SQL where it can express them."""

from __future__ import annotations

from strandloom.llm import (
    alignment,
    brown,
    bytebpe,
    chunks,
    extract,
    fingerprints,
    jaccard,
    language,
    merkle,
    neighbours,
    packing,
    quality,
    sharding,
)


def _table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_nn_descent(spark, sf_dir):
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_nearest_centroid(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), language.held_out_by(5, 0))


def op3_heavy_light(spark, sf_dir):
    return jaccard.join_sets(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("th", "component")


def op4_brown_classes(spark, sf_dir):
    return brown.score(_table(spark, sf_dir, "documents", "doc_id", "text"), language.held_out_by(7, 2))


def op5_chunk_reuse(spark, sf_dir):
    return chunks.encode_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_prefix_hashes(spark, sf_dir):
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_sampled_splitters(spark, sf_dir):
    return sharding.shard_by_size(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_tree_scoring(spark, sf_dir):
    return extract.extract_pages(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_minimum_bin_slack(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_co_training(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars"),
                            _table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_token_incidence(spark, sf_dir):
    return alignment.align_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_sibling_shift(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", *merkle.FIELDS)
    return merkle.manifest(docs, merkle.crc_divisible("doc_id", 5)).drop("source", "idx")


def op13_rank_merging(spark, sf_dir):
    return bytebpe.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_nearest_centroid, op3_heavy_light, op4_brown_classes, op5_chunk_reuse, op6_prefix_hashes, op7_sampled_splitters, op8_tree_scoring, op9_minimum_bin_slack, op10_co_training, op11_token_incidence, op12_sibling_shift, op13_rank_merging)}
#: Every value with its byte count in front.  The CRC of the decimal id is taken bit by bit over its characters.
_OP12_SQL = r"""
WITH RECURSIVE crcs AS (
    SELECT doc_id, source, lang, n_chars, text, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(
        flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
        lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) END AS crc
    FROM documents),
forms AS (SELECT *, CASE WHEN crc % 5 = 0
        THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS held FROM crcs),
heads AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM forms),
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(held) || ':' || held, '-')) AS held FROM heads),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS rid FROM hashed),
nodes AS (SELECT tree, 0 AS lev, idx, leaf AS digest, n FROM leaves UNION ALL
    SELECT tree, lev + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 15) // 16)
    FROM nodes WHERE n > 1 GROUP BY tree, lev, idx // 16),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS lev, idx, subroot AS digest, n FROM subroots UNION ALL
    SELECT lev + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 15) // 16)
    FROM upper_nodes WHERE n > 1 GROUP BY lev, idx // 16),
runs AS (SELECT tree, lev, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT lev, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM upper_nodes WHERE n > 1 GROUP BY ALL),
fold AS (SELECT rid, tree, 0 AS lev, idx, n, held AS cur, '' AS sibs FROM leaves UNION ALL
    SELECT f.rid, f.tree, f.lev + 1, f.idx // 16, (f.n + 15) // 16,
        sha256(array_to_string(list_transform(r.ds, lambda x, i: CASE WHEN i = f.idx % 16 + 1 THEN f.cur ELSE x END), '')),
        f.sibs || array_to_string(list_filter(r.ds, lambda x, i: i <> f.idx % 16 + 1), '')
    FROM fold f JOIN runs r ON f.tree = r.tree AND f.lev = r.lev AND f.idx // 16 = r.run),
upper_fold AS (SELECT f.rid, 0 AS lev, s.idx, s.n, f.cur, f.sibs FROM fold f JOIN subroots s ON f.tree = s.tree WHERE f.n = 1 UNION ALL
    SELECT f.rid, f.lev + 1, f.idx // 16, (f.n + 15) // 16,
        sha256(array_to_string(list_transform(r.ds, lambda x, i: CASE WHEN i = f.idx % 16 + 1 THEN f.cur ELSE x END), '')),
        f.sibs || array_to_string(list_filter(r.ds, lambda x, i: i <> f.idx % 16 + 1), '')
    FROM upper_fold f JOIN upper_runs r ON f.lev = r.lev AND f.idx // 16 = r.run)
SELECT l.doc_id, l.leaf, s.subroot, u.digest AS root, sha256(f.sibs) AS proof_sha256, f.cur AS folded_root, f.cur = u.digest AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN upper_fold f ON l.rid = f.rid AND f.n = 1 JOIN upper_nodes u ON u.n = 1
"""
ORACLES: dict[str, str] = {"op12_sibling_shift": _OP12_SQL}
