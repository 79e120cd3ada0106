"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage takes and returns the columns of ``documents``; the last returns
ids. Between stages rows are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.llm.anchors import substring_dedup
from layerscan.llm.benchmarks import find_leaks
from layerscan.llm.minhash import near_duplicates
from layerscan.llm.pieces import encode
from layerscan.llm.quality import fit, judge
from layerscan.session import materialize

#: Similarity, in percent, from which documents are near duplicates.
NEAR_PERCENT = 80


def _back(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from the struct ``rest``, some of them changed."""
    return rows.select(*(changed.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(judge(docs, model, tuple(docs.columns)).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Rows of one id stay or go together; rows without an id stay.
    """
    kept = near_duplicates(docs, percent=NEAR_PERCENT).where("kept").select(F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a smaller id also has.

    A text that loses nothing stays as it is; one that loses all its words goes.
    """
    carry = tuple(c for c in docs.columns if c != "text")
    cut = substring_dedup(docs, carry=carry, rejoin=False).where("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return _back(cut, docs, text=F.col("kept_text"), n_chars=length)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions, also with other numbers and names."""
    carry = tuple(c for c in docs.columns if c != "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry)
    return _back(found.where(F.size("item_ids") == 0), docs, text=F.col("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    out = encode(docs, carry=("lang", "source", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "rest.lang", "rest.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.col("rest.text")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", repeat_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: Trained and merged models have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
