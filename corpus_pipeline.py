"""A training corpus from raw documents, in five stages.

Language ID, quality classifier and n-gram Jaccard join drop documents; mixing repeats or drops them so that each
source comes near its target; packing lays the tokens of what is left into sequences of 4096.
Columns of documents that bear a name used here keep their values: helper columns take names that documents lack.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm.common import checkpoint_folder, cut_lineage, free_name, read_table
from cleargrain.llm.langid import UNKNOWN, fit_languages, with_language
from cleargrain.llm.mixing import mix_rows
from cleargrain.llm.ngram_join import group_ngrams
from cleargrain.llm.packing import pack_documents
from cleargrain.llm.quality import fit_quality, with_quality

#: A document stays if its language's share of the evidence is no less.
LEAST_LANGUAGE_SCORE = 0.5
LEAST_QUALITY_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and such whose language stays in doubt."""
    name = free_name(docs, "language")
    found = with_language(docs, fit_languages(docs), name)
    sure = (F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose neighbours' labels speak against them."""
    name = free_name(docs, "quality")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return with_quality(docs, model, name=name).where(F.col(name) >= LEAST_QUALITY_SCORE).select(*docs.columns)


def with_rows(docs: DataFrame, other: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """docs joined to other where keys (names of docs: names of other) are equal, nulls too. other's keys take names of their own."""
    names = {theirs: free_name(docs, f"other_{theirs}") for theirs in keys.values()}
    return docs.join(other.withColumnsRenamed(names), reduce(and_, [F.col(own).eqNullSafe(F.col(names[theirs])) for own, theirs in keys.items()]), how)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays (of several, one text; of equal rows, one).

    Rows are told apart by doc_id and text: different texts that share an id, or have none, fall only to their own group. Texts
    without words stay.
    """
    grouped = cut_lineage(group_ngrams(docs).select("doc_id", "mark", "n_shingles", "kept"))
    mark = free_name(docs, "mark")
    left = with_rows(docs.withColumn(mark, F.xxhash64("text")), grouped.where("not kept").select("doc_id", "mark").distinct(), {"doc_id": "doc_id", mark: "mark"}, "left_anti")
    repeated = cut_lineage(grouped.where("kept and n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"))
    if not repeated.isEmpty():
        once = with_rows(left, repeated, {"doc_id": "doc_id", mark: "mark"}, "left_semi").dropDuplicates(["doc_id", mark])
        left = with_rows(left, repeated, {"doc_id": "doc_id", mark: "mark"}, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; one that it takes in part counts as taken."""
    key, times, number = (free_name(docs, name) for name in ("text_key", "times", "copy"))
    copies = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix_rows(docs).groupBy("doc_id", "source", "text_md5").agg(F.max(copies).alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    met = with_rows(keyed, taken, {"doc_id": "doc_id", "source": "source", key: "text_md5"}, "inner")
    return met.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written to the shared checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
