"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes every stage's rows as Parquet and reads them
again as the next one's.  All stages but the last return the columns of
``documents``.  No stage can be written in SQL, so there is none; the tests
hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import decontaminate, hyperminhash, packing, pii, quality
from attrition.llm.common import documents, find_modules
from attrition.llm.queries import tokenizer_path
from attrition.session import materialize

ORACLE_SQL = None
#: Share of 5-word shingles that makes two documents near duplicates.
WORDS, SIMILAR, OF = 5, 80, 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores at 0.5 or more.  It is
    trained on labels of the documents at hand."""
    net = quality.train(find_modules(spark), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id;
    documents without words stay.  Rows that repeat a kept document in id and
    words are copies too: one stays."""
    found = hyperminhash.near_duplicates(docs, WORDS, SIMILAR, OF)
    id_, key, h1, h2 = (free_name(n, docs) for n in ("node", "key", "h1", "h2"))
    gone = found.where("node <> component").select(F.col("node").alias(id_), F.col("s1").alias(h1), F.col("s2").alias(h2))
    repeated = found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias(id_))
    rows = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(hyperminhash.LEAST)))
    # ids that occur once (all, as a rule) need no look at their words
    single = rows.join(repeated, id_, "left_anti").join(gone.select(id_), id_, "left_anti")
    # of the others a row goes by its own words, not by its id
    many = rows.join(repeated, id_, "left_semi").withColumn(key, F.xxhash64("text"))
    words = hyperminhash.signatures(many.select(F.col(key).alias("doc_id"), "text"), WORDS).select(
        F.col("node").alias(key), F.col("s1").alias(h1), F.col("s2").alias(h2)).distinct()
    many = many.join(words, key).join(gone, [id_, h1, h2], "left_anti").dropDuplicates([id_, h1, h2])
    return single.select(*docs.columns).unionByName(many.select(*docs.columns))


def free_name(name: str, docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    while name in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with
    their token ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
