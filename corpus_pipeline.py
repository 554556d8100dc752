"""Corpus pipeline: language, near copies, repeated passages, benchmark passages, token round trip.

Every stage takes the documents that the one before it left, reads whole texts and writes its result;
all but the last return the columns of ``documents``. Decisions:

* language_id: documents without letters, or whose two best languages are tied, go;
* minhash: of each group of near copies (five-word shingles, similarity of 0.8) the smallest id stays;
* suffixes: strings of 400 bytes that occur more than once are cut out of the texts; a character that
  a cut splits goes as a whole, and ``n_chars`` is counted anew;
* decontamination: documents in which benchmark windows cover a twentieth of the words go;
* byte_bpe: texts become token ids with the digest of what they decode to; a document whose tokens do
  not decode to its text would be a fault of the tokenizer and stops the run.

Empty tables pass through. Null texts go in the first stage, as they have no letters. Repeated ids and
rows without one are judged like all others; extra columns are kept until the last stage, but
for those named like a result of a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, langid, minhash, suffixes
from tablewright.llm.common import drop_stage, lean_workers, stage, table
from tablewright.llm.queries import RANKS, language_model, reach_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepare(spark: SparkSession) -> None:
    reach_package(spark)
    lean_workers(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    found = langid.identify(docs, language_model(docs))
    return found.filter("not rejected").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    copies = minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_copy"))
    return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    done = suffixes.remove_repeats(docs)
    cut = F.col("n_removed") > 0
    new = {
        "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")),
        "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")),
    }
    return done.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    done = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = F.when(same, F.sha2("decoded", 256)).otherwise(F.raise_error(F.lit("tokens do not decode to their text")).cast("string"))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", checked.alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("byte_bpe", tokens),
]
#: Compression sizes and token merges cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again; what was read last is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_stage(spark, last)
        last = docs
    return docs
