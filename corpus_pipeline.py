"""A training corpus from ``documents``: five stages, each over all that the one before has kept.

A stage's result must be stored before the next stage is called, as ``run`` does: the tables that a stage has written
for itself are deleted then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, ngram_join, quality, sentencepiece_codec, substring
from helixframe.llm._io import collected, deleted, dropped, may_occur, swept, table, written
from helixframe.llm.queries import PIECE_MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the last stage.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(spark, _left)
        swept(spark)
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        _left[:] = paths
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't fail the base rules and whose posterior quality passes stay.

    Null and empty texts have no words and go; very long ones are judged whole; repeated rows are judged alike and count
    each; an empty table gives an empty one; columns called like the operator's measures come through unchanged.
    """
    told = [F.col(c).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)]
    judged = quality.judged(docs.select(*told), text=f"_doc_{docs.columns.index('text')}")
    return judged.where("kept").select(*(F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)))


@_tidy
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays.

    Texts without words link with nothing and stay, as do rows without a doc_id; rows that repeat a doc_id stay or go
    together; ties can't occur, since a group has one smallest doc_id; an empty table gives an empty one.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    groups = ngram_join.jaccard_components(keyed, k=5, percent=80)
    gone = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    told = may_occur(docs, "doc_id", gone, "_may")  # rows that surely stay aren't shuffled
    return told.where("NOT _may").unionByName(told.where("_may").join(gone, "doc_id", "left_anti")).select(*docs.columns)


@_tidy
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat 13 words or more of a document with a smaller doc_id go; other texts stay as they are.

    A text that loses all its words goes with its row; null, empty and short texts stay; rows of one doc_id don't remove
    each other's words; an empty table gives an empty one; a column ``n_chars`` follows the new text, other columns come
    through unchanged.
    """
    told = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = substring.without_repeats(docs.withColumnsRenamed(told))
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    out = {c: text if c == "text" else F.col(told.get(c, c)) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(whole, out["n_chars"]).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return done.where("n_removed = 0 OR n_removed < n_words").select(*(v.alias(c) for c, v in out.items()))


@_tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter one, go.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; without items all rows stay; columns
    called like the operator's results come through unchanged.
    """
    told = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = decontaminate.search_items(docs.withColumnsRenamed(told), table(spark, sf_dir, "benchmark")).where("n_hit = 0")
    return found.select(*(F.col(told.get(c, c)).alias(c) for c in docs.columns))


@_tidy
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (with an end id) and the digest of the text decoded from them.

    Null and empty texts have the end id alone; very long texts are coded whole; repeated rows all stay; an empty table
    gives an empty one; other columns aren't read.
    """
    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), PIECE_MODEL)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.split()[0].lower())
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning by expectation-maximisation and sub-word merges aren't SQL; tests use brute force.
ORACLE_SQL = None
