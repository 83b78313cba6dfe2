"""One query for each operator, with production parameters over its whole
table.  They are checked against brute-force versions in ``tests/llm``: none
can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import (conversation_repair, decontaminate, hyperminhash, licenses, packing, pii, quality, rank_bpe, sharding,
                           simhash, substring_dedup, suffix_dedup, token_alignment)
from attrition.llm.common import documents, find_modules
from attrition.llm.registry import register
from attrition.session import materialize, scratch_path

N_SHARDS = 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer lies on this machine (the executors' too)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_virtual_slots")
def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of near-equal bytes (law ``bytes``): the
    first map deals slots in turn, its second version, edited by bytes per
    slot, is stored and read again."""
    digests = materialize(sharding.digest(documents(spark, sf_dir)), "digests")
    size, rows = sharding.slot_bytes(digests)
    path = scratch_path(spark, "slot-maps")
    first = sharding.SlotMap.first(sharding.N_SLOTS, N_SHARDS)
    sharding.store(spark, path, first)
    sharding.store(spark, path, sharding.rebalance(first, size))
    slots = sharding.load(spark, path)
    placed = sharding.assign(digests, slots, rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                         F.lit(slots.version).alias("map_version"))


@register("op2_suffix_array")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated 400-byte strings removed."""
    return suffix_dedup.deduplicate(documents(spark, sf_dir))


@register("op3_license_rules")
def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in every document."""
    return licenses.scan(documents(spark, sf_dir))


@register("op4_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; for ids divisible
    by 100, how many other documents lie within the Hamming radius that a
    similarity of 0.8 takes."""
    found = materialize(simhash.fingerprinted(documents(spark, sf_dir)), "simhash")
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    near = simhash.near_counts(found, asked)
    return found.join(near, "fingerprint", "left").select(
        *simhash.COLUMNS, F.when(asked, F.col("n_near")).alias("n_near"))


@register("op5_difference_cover")
def difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under later copies of 20-word windows removed."""
    return substring_dedup.deduplicate(documents(spark, sf_dir))


@register("op6_qgram_decontamination")
def qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or in part, within the edit
    budget: one row per document and item."""
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register("op7_karmarkar_karp")
def karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@register("op8_hyperminhash")
def hyperminhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard
    similarity of 0.8 or more."""
    found = hyperminhash.near_duplicates(documents(spark, sf_dir), words=4)
    return found.select(hyperminhash.original("node").alias("doc_id"), "n_shingles",
                        hyperminhash.original("component").alias("component_id"),
                        (F.col("node") == F.col("component")).alias("kept"))


@register("op9_crf_pii")
def crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.detect(documents(spark, sf_dir))


@register("op10_byte_cnn")
def byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    net = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, net)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op11_edit_lattice")
def edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after damage."""
    return conversation_repair.repair(find_modules(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


@register("op12_token_alignment")
def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of two tokenizers over every document."""
    return token_alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                                 tokenizer_path("piece_bpe_32k.model"))


@register("op13_rank_bpe")
def rank_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    return rank_bpe.digests(documents(spark, sf_dir), tokenizer_path())
