"""The operators bound to the provided tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, exact, likelihood, merkle, packing, shards, simhash, site_lines, suffixes, token_prefixes, units, warc, whitening
from barloom.llm.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_unit_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = units.repeated_units(table(spark, sf_dir, "documents"), unit="sentence", min_words=8)
    return gone.select("doc_id", F.col("start").alias("unit_start"), F.col("end").alias("unit_end"), "n_words", "kept_doc_id", "kept_start")


@query("op2_site_lines", sql="""
    WITH lines AS (
        SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
    ), kept AS (
        SELECT doc_id, source, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines
        WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3
    ), wide AS (
        SELECT line, min((doc_id, pos)) AS first FROM kept GROUP BY line HAVING count(DISTINCT source) >= 10
    ), gone AS (
        SELECT doc_id, pos FROM kept JOIN wide USING (line) WHERE (doc_id, pos) > first
    ), rest AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept_text, count(*) AS n_kept FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
           CAST(len(string_split(d.text, chr(10))) - coalesce(r.n_kept, 0) AS BIGINT) AS n_removed,
           md5(coalesce(r.kept_text, '')) AS kept_md5
    FROM documents d LEFT JOIN rest r USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = site_lines.drop_boilerplate(table(spark, sf_dir, "documents"), sites=10, min_words=3)
    return cut.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


@query("op3_token_prefixes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefixes.token_prefixes(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"), budget=512, table=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op4_benchmark_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op5_likelihood_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


@query("op6_byte_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents"), shards=24, overhead=8)


@query("op7_simhash_components")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query("op8_configuration_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


@query("op9_warc_salvage")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_path(pages, "warc")
    warc.write_archives(pages, path, least=0, compression="records")
    records = warc.read_archives(spark, path, blocks=False).where("kind = 'record'")
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


@query("op10_suffix_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200, kept=False).drop("removed_spans")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


@query("op12_merkle_manifest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], group="lang", claimed={"text": exact.ascii_lower(F.col("text"))}, when=third)


@query("op13_exact_groups", sql="""
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))
