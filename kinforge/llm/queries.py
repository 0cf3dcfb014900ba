"""The registered queries of the training-data operators, with production parameters.

SQL twins are given only where DuckDB can express an operator over whole tables; the others are tested
against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, packing, quality_mil, quality_rules, records, sharding, simhash, substring, vectors
from .tokens import default_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree_of(40), sharding.tree_of(41))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path())


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op4_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op5_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op6_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.learn())


def op7_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score_documents(docs, quality_mil.learn(docs, table(spark, sf_dir, "labels")))


def op9_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tokens_roundtrip(table(spark, sf_dir, "documents"), default_path())


def op10_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_roundtrip(table(spark, sf_dir, "documents"), default_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hash_tree_sharding, op2_pattern_packing, op3_pivot_permutation, op4_relative_lz, op5_multi_index_simhash, op6_dom_model, op7_boosted_rules, op8_attention_mil, op9_record_files, op10_batched_bpe)}


#: Window by window, over all words of all texts.
SUBSTRING = """
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
win as (select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) as key, count(*) over (partition by doc_id order by i rows between current row and 19 following) as n, word from word),
again as (select *, n = 20 and row_number() over (partition by key, n order by doc_id, i) > 1 as again from win),
gone as (select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from again),
kept as (select doc_id, count(*) as n_words, count_if(gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from gone group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join kept using (doc_id)
"""
#: Every pair of vectors, and what can be reached by links.
VECTORS = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings), u as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as component_id from reach group by a), n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from v join least on vec_id = least.a left join n on vec_id = n.a
"""


def oracle_sql() -> dict[str, str]:
    """op3's twin compares all pairs, which its index finds nearly all of (see README)."""
    return {"op1_hash_tree_sharding": sharding.sql_of(sharding.tree_of(40), sharding.tree_of(41)), "op3_pivot_permutation": VECTORS, "op4_relative_lz": SUBSTRING}
