"""From documents to token ids: the stages of a training corpus, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import bpe, lines, mixing, simhash, toxicity
from strandlog.llm._common import stage, table
from strandlog.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts score as examples without known terms do; without labels of both kinds
    all documents stay. Rows that repeat, also with one doc_id or none, are scored by their own texts.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match a line of an earlier place.

    Null texts stay null, and texts may become empty; rows stay, in any number and of any doc_id.
    Lines of rows that share a doc_id have equal places where their numbers are equal, and do not remove each other there.
    """
    return lines.deduplicated(docs).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash component, null ids last, then of the least text digest.

    Null, empty and white texts have one fingerprint and so are one component.
    """
    return simhash.keep_one(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order.

    Documents without words take no part; a null source is a source. Documents are taken in whole, also in their last round.
    """
    return mixing.emit(mixing.assign(docs), whole=True).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text they decode to; rows repeat as the mix repeats them. Empty tables give empty ones throughout."""
    return bpe.encode(docs, TOKENIZER, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: No SQL: the scores, fingerprints and tokens of the stages can't be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
