"""From raw documents to token ids in five stages.

Each stage reads what the one before it wrote and works on all of it:

1. language: documents without a language that the profiles know (no letters, or n-grams far out
   of place in every profile) go
2. near_duplicates: of each group of near copies the document with the smallest id stays
3. decontaminate: documents with a passage of the benchmark go
4. personal_data: personal data, and terms that give it away, are replaced in the texts
5. tokens: texts become byte-level BPE ids, and the ids are decoded again

Null and empty texts are rejected by the first stage; of rows that repeat an id and a text one stays
after the second; null ids pass as each operator's docstring says; columns other than doc_id, text and
lang pass through the first four stages unchanged, whatever their names; empty tables give empty results.
What a stage's operators left in the shared folder is deleted after it (tables of other calls are left alone),
and so is each stage's table once the next one is written, but for the last, which the caller's scope() owns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm.bpe import Vocabulary, decode, encode
from trackforge.llm.common import Scratch, scope, table, unused
from trackforge.llm.decontam import decontaminate as without_benchmark
from trackforge.llm.langid import identify, learn
from trackforge.llm.minhash import without_near_duplicates
from trackforge.llm.pii import sanitise
from trackforge.llm.q_langid import held_out

#: Documents whose n-grams are further out of place than this in every language go. Documents of
#: the learnt languages score 0.45 and more, however short.
LEAST_SCORE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = learn(docs, ~held_out())
    pred, score = unused(docs.columns, "lang_pred", "lang_score")
    judged = identify(docs, profiles, to=(pred, score))
    return judged.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    voc = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = decode(encode(docs, voc), voc)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can express neither n-gram profiles nor merges by rank; tests/llm hold the rows against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, f"pipeline-{name}")
        with scope():
            docs = scratch.write(stage(spark, docs, sf_dir))
        if before:
            before.clear()
        before = scratch
    return docs
