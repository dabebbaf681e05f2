"""Raw documents to packed sequences: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents, whatever other columns there are and however they are named. Null and empty texts end at
the first stage; an empty table passes every stage; ties and repeated rows are each stage's own (below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import WHITE, column, discard, documents, own_prefix, temporary, written
from tesselark.llm.decontaminate import contamination
from tesselark.llm.line_dedup import dedup_lines
from tesselark.llm.ngram_join import ngram_components
from tesselark.llm.packing import pack_documents
from tesselark.llm.quality_rules import quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio. Rows are judged one by one: repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(docs, labels)
    return out.where(column(out.columns[-1])["kept"]).select(*_columns(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; those left without a word (nothing but ASCII white space) go. n_chars follows the text. Rows of
    equal id are one document, rows without id the last one, so repeated rows keep their lines; the next stage drops them."""
    out = dedup_lines(docs).where(F.length(F.btrim("text", F.lit(WHITE))) > 0)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else column(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the one of least id. Where ids are null or repeated, each row is a document of its own: the row of least
    id (none comes last, of equal ids the first stored) stays, so exact copies under one id or without any go as well. Rows without words stay."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if n["n"] == n["ids"]:
        gone = written(ngram_components(docs).where("component_id <> doc_id").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))
    row = own_prefix(docs) + "row"
    named = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = ngram_components(named, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    kept = named.select("doc_id", row).join(groups, row).groupBy("component_id").agg(F.min(place).alias("x"))
    kept = written(kept.select(F.col("x.row").alias(row)))
    return named.join(kept, row, "left_semi").select(*_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage. Rows equal in id and text stay or go together."""
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(column(out.columns[-1])["n_hit"] == 0).select(*_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in the packed sequences; every row is a document of its own."""
    return pack_documents(docs)


def _columns(docs: DataFrame) -> list:
    return [column(c) for c in docs.columns]


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A tokenizer and a likelihood ratio over hashed features are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder, and what a stage stored on its way there is deleted."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before = docs
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir)))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
