"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; its
result is written as Parquet into the shared folder and reread by the next
one. All stages but the last return the columns of ``documents``.

The stages run one after the other: once a stage's result is written, what the
stage kept in the scratch folder is of no more use, and the next stage removes
it (but for what its own ``docs`` read).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import block_naming, bpe_rounds, language_tags, ngram_join, source_mixing
from veilspark.llm.store import written
from veilspark.session import remove_scratch, scratch_folders
from veilspark.sources.tables import table

#: Tokens that the mix may keep, as a share of those it is given; no document is used twice.
MIX_PERCENT = 80
#: Words that a worker's table holds: workers stay beside the executors' heaps, which grow from stage to stage.
TABLE_WORDS = 400_000

_left: list[str] = []


def _only(docs: DataFrame, stage: Callable[[], DataFrame]) -> DataFrame:
    """The stage's result; the scratch folders that earlier stages left go first."""
    files = docs.inputFiles()
    remove_scratch([base for base in _left if not any(base.rsplit("/", 1)[1] in f for f in files)])
    before = set(scratch_folders())
    out = stage()
    _left[:] = [base for base in scratch_folders() if base in _left or base not in before]
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (null, or no letter) go; mixed and unsure ones stay."""
    return _only(docs, lambda: language_tags.accepted(docs, table_words=TABLE_WORDS))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the smallest doc_id stays, also if ids repeat or are missing."""
    return _only(docs, lambda: block_naming.first_rows(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest doc_id stays, also if ids repeat or are missing."""
    return _only(docs, lambda: ngram_join.drop_near_copies(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights keep, whole."""
    return _only(docs, lambda: source_mixing.chosen(docs, percent=MIX_PERCENT, max_epochs=1))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept documents."""
    return _only(docs, lambda: bpe_rounds.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), table_words=TABLE_WORDS))


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("source_mix", mixture), ("bpe_encode", encoded)]

#: The language model and the tokenizer cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
