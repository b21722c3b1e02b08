"""Five stages from raw documents to packed sequences; each is written and read again.

Rows are judged one by one, not by doc_id: rows without an id, or with one id and different texts, stand for themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.llm import decontaminate, linededup, packing, quality, simhash
from lattica.llm.common import fresh_path, numbered, table, unused


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go.  All labels train it: nothing is held out here."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def line_stage(spark, docs, sf_dir):
    """Lines on many sites go; a document that consisted of nothing else stays, empty."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each component stays: the one that names it, or any of one without ids."""
    name = unused(docs, "_row")
    rows = numbered(docs, name)
    return rows.join(simhash.one_of_each(rows, name), name, "left_semi").select(*docs.columns)


def benchmark_stage(spark, docs, sf_dir):
    """Contaminated rows go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: A classifier, a sketch and a tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
