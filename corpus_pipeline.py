"""Corpus pipeline: five stages, each by one operator, over whole tables.

Quality classifier, quality rules, near-duplicates, substring dedup and packing. Each stage works on all that the one before it kept; what is between two
stages is written as Parquet to the shared folder and read again, so an executor's
loss never reaches back beyond a stage. All stages but the last return the columns
of documents; null texts, repeated rows and empty tables are as the operators
define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, nbsvm, packing, quality_rules, simhash_sets, substring_dedup
from lodestone.llm.queries import held_out, table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; fitted to labelled documents among them, but for the held-out fifth.

    Texts are read whole, however long; a score of exactly 0.3 stays, equal texts score
    alike, repeated rows stay or go together; a null or empty text scores by the bias.
    """
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = common.fresh(docs, stem="__score")
    return nbsvm.score(docs, model, out=score).where(F.col(score) >= 0.3).drop(score)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands of their language keep.

    Texts are read whole, however long; the ends of a band belong to it, equal texts of a
    language are judged alike; a null or empty text goes.
    """
    verdict = common.fresh(docs, stem="__rules")
    return quality_rules.measure(docs, vocabulary("piece_bpe_32k.model"), out=verdict).where(F.col(f"{verdict}.kept")).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more.

    Candidates are documents whose SimHash fingerprints meet in a segment of a multi-index
    and agree in most of further bits; each link is the exact similarity of the whole shingle
    sets, however long the texts. The row that Spark reads first stays of a group, repeated
    rows and null ids included; null and empty texts are one group; a similarity of exactly
    0.8 links.
    """
    row, node, entries, check = (common.fresh(docs, stem=s) for s in ("__row", "__node", "__entries", "__check"))
    marked = simhash_sets.marks(docs.withColumn(row, F.monotonically_increasing_id()), node=node, entries=entries, check=check)
    marked = common.written(marked, "marked")
    found = simhash_sets.groups(marked, row, threshold=0.8, node=node, entries=entries, check=check)
    first = found.where(F.col(row) == F.col("component_id")).select(row)
    return marked.join(first, row, "left_semi").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words that repeat; others keep their text as it is.

    Texts are read whole, however long; every copy of a passage goes, repeated rows
    included, so no tie is to be broken; a null text stays null.
    """
    found = common.fresh(docs, stem="__stripped")
    cut = F.col(f"{found}.n_removed") > 0
    text = F.when(cut, F.col(f"{found}.kept_text")).otherwise(F.col("text"))
    stripped = substring_dedup.dedup(docs, out=found)
    stripped = stripped.withColumns({"text": text, "n_chars": F.when(cut, F.length(f"{found}.kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return stripped.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    Texts of any length are cut, not shortened; of windows with equal room the one opened
    first is filled; a null or empty text is its end token; repeated rows are packed each.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packed),
]

#: No stage can be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
