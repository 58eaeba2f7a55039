"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` applies them to the documents table, writing each stage's rows to the shared
folder before the next reads them and deleting those that no stage reads any more.

Defined cases, for every stage: an empty table gives an empty table; texts of any length are read
whole; null texts count as empty; ids may be null or repeat, and rows of one id are documents each;
columns other than those of documents are dropped, whatever their names. What a stage does with ties
and repeated rows is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tracewright.llm.common import materialise, read_table, release
from tracewright.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; one fifth of the labels is left out of its training.

    Repeated rows score alike, so all stay or go. Without labels of both kinds every document stays.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model, carry=("text", "lang", "source", "n_chars")).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the least id, null ids last.

    Groups come from texts alone, so different texts of one id stay. Null and empty texts are one
    group. Ties of one id go to the least hash of the row; of rows alike in all columns one stays.
    """
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur again; texts of which nothing is left go.

    A character that a cut would halve goes whole; all others stay as they are. Repeated rows repeat
    each other's text, so of texts that long nothing stays. Texts without a cut stay, null ones as empty.
    """
    out = suffix_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"), characters=True)
    cut = F.col("n_removed") > 0
    out = out.withColumn("text", F.col("kept").cast("string")).where(~cut | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, spread evenly over domains, languages and sources as far as they last.

    Null languages and sources are leaves of their own. Rows of one id and text have one place in the
    seeded order, so all stay or go. Texts without tokens stay where the order puts them before the cut.
    """
    return mixing.mix(docs.select(*COLUMNS), 0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence of at most 4096 tokens.

    A null or empty text is the end token alone; repeated rows are packed each; null ids stay null.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, union-find over hashes and best-fit bins have no SQL form; tests/llm/test_pipeline.py holds each
#: stage on its own input, and run() as a whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialise(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
