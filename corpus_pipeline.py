"""A corpus from raw documents to packed training sequences; part of the subpackage llm.

Stages: language ID rejects documents without a language; line dedup cuts recurring lines; the Jaccard join leaves one document of each group
of near copies; decontamination drops documents that hold a benchmark item; packing lays out what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import find_leaks
from millrace.llm.jaccard import jaccard_components
from millrace.llm.langid import identify
from millrace.llm.packing import pack_documents
from millrace.llm.queries import tokenizer_path
from millrace.llm.shared import staged, table, unused
from millrace.llm.templates import dedup_lines


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined: no text, no letter, or two codewords about equally near. All columns pass."""
    learn = F.expr("crc32(cast(doc_id as string)) % 4 <> 2")
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # so that no column is named like one of the operator's
    if dict(docs.dtypes).get("text") == "string":
        names["text"] = "text"  # goes to Python and back once
    found = identify(docs, learn, keep={n: F.col(c) for c, n in names.items() if n != "text"}, with_text=names.get("text") == "text")
    return found.where("lang_pred <> 'und' and not ambiguous").select(*[F.col(n).alias(c) for c, n in names.items()])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of recurring templates; n_chars follows the text."""
    return dedup_lines(docs).select(*[F.coalesce(F.length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique key, written once so that it reads the same each time (an id may be null or repeat), and the key's name."""
    key = unused(docs, "__row")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of smallest id, rows without an id last."""
    keyed, key = _keyed(docs)
    found = jaccard_components(keyed, id_col=key).where("doc_id <> component_id")
    copies = staged(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), "near-copies")
    members = copies.unionByName(copies.select(F.col("root").alias("row"), "root").distinct())
    named = members.join(keyed.select(F.col(key).alias("row"), "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = staged(named.groupBy("root").agg(first).select("first.row"), "kept")
    gone = staged(members.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", key), "gone")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold an item of the benchmark."""
    keyed, key = _keyed(docs)
    found = find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    leaks = staged(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_copy_stage), ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again between.

    Rows are decided one by one, so ids may be null or repeat. Null and empty texts have no language and go first; a text that loses all lines
    stays, empty, and is one piece of length 1. Columns other than doc_id, text, lang and n_chars pass through, whatever their names, up to the
    last stage. No documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
