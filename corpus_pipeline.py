"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
documents; the last returns the mix: a row per document that the mix takes, with the words it takes.

Rows are told apart by doc_id and text, null ones too. Other columns keep their names and values whatever they are called.
Of rows that repeat doc_id and text, the one whose columns come first as JSON stays; reruns agree. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, ngram_join
from tessera.llm.common import cut, plain, small, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter."""
    rows, named = plain(docs)
    doc, text, lang = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang"))
    return language_id.identify(rows, doc, text, lang).where(F.col("lang_pred") != language_id.UNKNOWN).select(*named)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that of least doc_id (null last), then least md5 of its text. Texts without words are in none and stay."""
    rows, named = plain(docs)
    doc, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    found = cut(ngram_join.join(rows, doc, text, marked=True).where("root is not null").select("doc_id", "mark", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    groups = found.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("n")).where("n > 1").select("root", "k")
    members = found.join(small(cut(groups)), "root").select("doc_id", "mark", (order == F.col("k")).alias("stays"))
    members = cut(members.groupBy("doc_id", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    go = members.where("not stays").select("doc_id", "mark")
    often = members.where("stays and n > 1").select("doc_id", "mark")

    rows = rows.withColumn("m", ngram_join.mark_of(F.col(text)))
    same = lambda keys: F.col(doc).eqNullSafe(keys["doc_id"]) & (F.col("m") == keys["mark"])
    go, often = small(go), small(often)
    rows = rows.join(go, same(go), "left_anti")
    # rows that repeat doc_id and text, of which there are few kinds
    one = rows.join(often, same(often), "left_semi").groupBy(doc, "m").agg(F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns))).alias("r")).select("r.*")
    return rows.join(often, same(often), "left_anti").unionByName(one).select(*named)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark window go."""
    rows, named = plain(docs)
    doc, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    hit = small(cut(decontaminate.find(rows, table(spark, sf_dir, "benchmark"), doc, text).where("contaminated").select("doc_id", "key").distinct()))
    rows = rows.withColumn("m", F.md5(F.col(text).cast("binary")))
    return rows.join(hit, F.col(doc).eqNullSafe(hit["doc_id"]) & (F.col("m") == hit["key"]), "left_anti").select(*named)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, inclusion, taken) of what the mix takes."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]
#: Language ID is learned and the join's components are recursive; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
