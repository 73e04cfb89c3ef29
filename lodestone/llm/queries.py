"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import binary_codes, common, license_scan, nbsvm, packing, quality_rules, sharding, simhash, substring_dedup, trie_bpe, warc


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; LODESTONE_VOCABULARIES can name another folder."""
    return os.path.join(os.environ.get("LODESTONE_VOCABULARIES", "/opt/tokenizers"), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rules = quality_rules.measure(docs, vocabulary("piece_bpe_32k.model"))
    return rules.select("doc_id", "rules.*")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"))
    payload = F.col("response.payload")
    revisit = F.col("response.record_type") == "revisit"
    return captures.select(
        F.col("metadata.page_id").cast("long").alias("page_id"),
        warc.payload_bytes().alias("payload_bytes"),
        F.when(revisit, F.substring_index("response.payload_digest", ":", -1)).otherwise(warc.base32_sha1(payload)).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to_page").cast("long").alias("refers_to"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(column: str = "doc_id") -> F.Column:
    """The fifth of the ids that no fit may learn from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return nbsvm.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = trie_bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("part"), (F.col("doc_id") % 16).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = license_scan.own_licenses(docs.select("doc_id", path.alias("path"), "text"), "text").drop("text")
    found = license_scan.inherit(common.written(files, "own"), "path")  # several branches read it; texts are scanned once
    return found.select("doc_id", "path", F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"), "license", "inherited_from", "inherited_depth")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = simhash.fingerprints(docs).select("doc_id", "lanes")
    found = simhash.components_of(marked)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.dedup(docs)
    return found.select("doc_id", "stripped.n_words", "stripped.n_removed", F.sha2("stripped.kept_text", 256).alias("kept_sha256"))


def op10_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.links(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_nbsvm": op4_nbsvm,
    "op5_trie_bpe": op5_trie_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_binary_codes": op10_binary_codes,
}

ORACLES = {
    "op2_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
        f as (select h, min(page_id) as first from p group by h),
        d as (select p.page_id, n, first, list_transform(range(0, 40, 5), lambda k: ('0x' || substr(p.h, k + 1, 5))::int) as g from p join f using (h))
        select page_id, n::bigint as payload_bytes,
            list_aggregate(list_transform(g, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id <> first then first end as refers_to
        from d""",
    "op9_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        h as (select doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as s from w where len(ws) >= 35)),
        r as (select doc_id, s from (select doc_id, s, count(*) over (partition by k) as c from h) where c > 1),
        gone as (select distinct doc_id, unnest(range(s, s + 35)) as i from r),
        each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
        kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as t from each anti join gone using (doc_id, i) group by doc_id)
        select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join kept using (doc_id)""",
    "op10_binary_codes": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join l on l.a = r.b),
        c as (select a as vec_id, min(b) as component_id from reach group by a),
        n as (select a as vec_id, count(*) as n from l group by a)
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)""",
}
