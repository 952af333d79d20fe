"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptframe.session import table

from . import (chaining, decontaminate, langid, minhash, packing, pii, quality, resampling, runs, sharding, stream_dedup,
               suffix, weakrules)
from .common import documents


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("rid", "first")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(documents(spark, sf_dir))


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.dedup_decisions(documents(spark, sf_dir))
    return found.selectExpr("id as doc_id", "keep_id", "group_size", "kept", "digest as text_sha256")


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("rid")


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakrules.judge(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir), planted=True)


QUERIES = {f.__name__: f for f in (
    op1_pattern_packing, op2_tensored_minhash, op3_latent_decontamination, op4_rank_profiles, op5_boosted_candidates,
    op6_collinear_chains, op7_cotrained_quality, op8_stream_dedup, op9_prefix_doubling, op10_hash_tree, op11_resampling,
    op12_weak_rules, op13_periodic_runs)}

ORACLES = {
    "op8_stream_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window g as (partition by coalesce(text, ''))""",
    "op11_resampling": """
        with texts as (
          select true as is_doc, doc_id, text from documents union all select false, item_id, text from benchmark),
        words as (
          select is_doc, doc_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word
          from texts where text is not null),
        crc_table as (
          select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
                   case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps),
        spelled as (select word, hex(encode(word)) as hexed from (select distinct word from words)),
        buckets as (
          select word, xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(range(length(hexed) // 2),
                                                           lambda i: cast('0x' || substr(hexed, 2 * i + 1, 2) as bigint))),
                   lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 10000 as bucket
          from spelled, crc_table),
        hashed as (select is_doc, doc_id, bucket from words join buckets using (word)),
        counts as (
          select bucket, count(*) filter (is_doc) as s, count(*) filter (not is_doc) as t from hashed group by bucket),
        totals as (select sum(s) as s_all, sum(t) as t_all from counts),
        gains as (
          select bucket, floor(1000 * ln(cast((t + 1) * (s_all + 10000) as double)
                                         / cast((s + 1) * (t_all + 10000) as double))) as gain
          from counts, totals),
        weighed as (
          select doc_id, count(*) as n, floor(sum(gain) / count(*)) as weight
          from hashed join gains using (bucket) where is_doc group by doc_id),
        scored as (
          select doc_id, coalesce(n, 0) as n, cast(coalesce(weight, 0) as bigint) as weight,
                 cast(coalesce(weight, 0) + floor(-1000 * ln(-ln(
                   (cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
          from documents left join weighed using (doc_id)),
        ranked as (
          select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as able
          from scored where n >= 20)
        select doc_id, n as n_features, weight, score, case when r <= able * 10 // 100 then r end as rank, n as n_words
        from scored left join ranked using (doc_id)""",
}
