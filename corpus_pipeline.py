"""A corpus pipeline: from raw documents to tokens, in stages that each write their result.

Stages: toxic documents go; one document of each near-duplicate group stays; repeated sentence spans are cut out;
documents that leak benchmark items go; texts are encoded.  A stage takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of documents, the last one with the encoding's digests besides.

Defined cases are those of the operators: null and empty texts pass every filter; a text of any length is read to its
end; of equal rows one stays, but all of those without words do; of a group of near copies the one with the smallest
doc_id stays, and of two texts of that id the one that hashes least; columns beyond those of documents are handed on,
whatever their names (but n_tokens, ids_sha256 and decoded_sha256, which the last stage replaces); n_chars, where it is
there, follows a text that was cut; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.lineage import shared_dir
from lumenlake.llm import decontamination, jaccard, spans, tokens, toxicity
from lumenlake.llm.common import read_table
from lumenlake.llm.queries import vocabulary_path


def _unused(docs: DataFrame, name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from the labels of the documents that are there."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    score = _unused(docs, "score")
    return toxicity.score_documents(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that a span further up has already."""
    removed = _unused(docs, "removed")
    cut = spans.remove_repeated(docs, removed=removed, spans=_unused(docs, "spans"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    leaks = _unused(docs, "leaks")
    found = decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the digests of their encoding."""
    return tokens.encode_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a Parquet table in the shared folder."""
    folder = shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express the trained scores, the tiling or the encoding; tests/llm holds every stage but the trained one
#: against brute force, and that one against a scorer without automaton.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY = {"pipeline": ORACLE_SQL}
