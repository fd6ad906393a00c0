"""Lines that many documents share are dropped: levelled sorted runs of line hashes, merge-anti-joined batch by batch."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ._io import deleted, dropped, fresh_path, viewed, written

#: ``[\\x20\\x09-\\x0D]``
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """An index of line hashes that grows batch by batch, as levels of sorted runs.

    A run is a table bucketed and sorted by ``line``: (line, n documents, top = largest document).  ``add`` drops from a
    new batch the lines that a run has settled - it counts ``documents`` or more and knows a document at least as
    large - by a merge anti-join per run, and adds what is left as a run of its own.  Runs share their buckets, so these
    joins shuffle the batch alone.  Two runs of a level are merged into one of the next by a merge join without a shuffle,
    so there are at most log2(batches) + 1 runs.  Batches may come in any order and repeat no (line, doc); the result is
    the same.
    """

    def __init__(self, spark: SparkSession, documents: int, buckets: int | None = None):
        self.spark, self.documents = spark, documents
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _stored(self, rows: DataFrame) -> str:
        path = fresh_path(self.spark, "run")
        name = "lines_" + path.rsplit("-", 1)[-1]
        rows.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _forgotten(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            deleted(self.spark, [self._paths.pop(name)])

    def _merged(self, one: str, other: str) -> str:
        a, b = (self.spark.table(x).select(*(F.col(c).alias(f"{c}_{i}") for c in ("line", "n", "top"))) for i, x in enumerate((one, other)))
        both = a.join(b.hint("merge"), F.col("line_0") == F.col("line_1"), "full")
        count = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
        run = self._stored(both.select(F.coalesce("line_0", "line_1").alias("line"), count.alias("n"), F.greatest("top_0", "top_1").alias("top")))
        self._forgotten([one, other])
        return run

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        if self.levels[level]:
            self._push(level + 1, self._merged(self.levels[level].pop(), run))
        else:
            self.levels[level].append(run)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The rows of (line, n, top) that the runs can't decide yet."""
        for run in self.runs:
            settled = self.spark.table(run).where(F.col("n") >= self.documents).select(F.col("line").alias("_line"), F.col("top").alias("_top"))
            counts = counts.join(settled.hint("merge"), (F.col("line") == F.col("_line")) & (F.col("top") <= F.col("_top")), "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """``lines``: distinct (line, doc) of a batch."""
        own = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top"))
        self._push(0, self._stored(self.unsettled(own)))

    def frequent(self) -> DataFrame:
        """(line, top) of all lines that ``documents`` or more documents hold; the runs are merged and deleted."""
        last, *others = self.runs
        for run in others:
            last = self._merged(last, run)
        out = written(self.spark.table(last).where(F.col("n") >= self.documents).select("line", "top"), "frequent")
        self._forgotten([last])
        self.levels = []
        return out


def line_key(line: Column) -> Column:
    """Only A-Z are lower-cased: ``lower`` does that to ASCII lines, and ``translate``, which is slower, to others."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """Distinct (line, doc): 128-bit hashes of the keys, ``chars`` code points or longer, of each document's lines."""
    lines = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= chars)).select(F.col(key).alias("doc"), F.explode(F.split(text, "\n")).alias("line"))
    keys = lines.where(F.octet_length("line") >= chars).select("doc", line_key(F.col("line")).alias("line")).where(F.length("line") >= chars)
    return keys.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"), "doc").distinct()


def _without(chars: int):
    @F.pandas_udf("kept string, n_dropped long")
    def without(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        """Drops the lines whose hash is in ``lost``; both are null for texts that stay whole."""
        kept, gone = [], []
        for t, hashes in zip(text, lost, strict=True):
            if t is None:
                kept.append(None)
                gone.append(0)
                continue
            hashes, lines = set(hashes), t.split("\n")
            stay = [x for x in lines if len(x) < chars or hashlib.md5(x.strip(BLANKS).encode().lower()).digest() not in hashes]
            kept.append("\n".join(stay))
            gone.append(len(lines) - len(stay))
        return pd.DataFrame({"kept": kept, "n_dropped": gone})

    return without


def without_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = 40, documents: int = 5, batches: int = 4) -> DataFrame:
    """(key, text, n_lines, n_dropped, kept_text): lines that ``documents`` or more documents share stay in the largest one.

    Lines are told apart by their keys: stripped of blanks at both ends, A-Z lower-cased, ``chars`` code points or more;
    shorter ones stay.  Documents are distinct ``key`` values; they enter the runs in ``batches`` by falling key (by hash
    if keys aren't numbers), so that most copies of a shared line meet a run that has settled it.  Lines are compared by
    128-bit MD5.  The texts are shuffled once, to the lines that they lose.

    Null and empty texts are one empty line; texts of any length are split whole, and a line that repeats inside the
    largest document stays there each time; rows that repeat a key are one document and lose the same lines; rows
    without a key count as no document and stay whole; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    lines = line_hashes(docs, "_key", "_text", chars)
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    if isinstance(docs.schema["_key"].dataType, NumericType):
        cuts = docs.select(F.percentile_approx("_key", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
        batch = sum((F.when(F.col("doc") <= c, 1).otherwise(0) for c in cuts), F.lit(0))  # the largest keys first
    path = fresh_path(spark, "lines")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.withColumn("batch", batch).schema).parquet(path)
    runs = LineRuns(spark, documents)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).drop("batch"))
    shared = runs.frequent()
    lost = lines.join(shared, "line").where("doc <> top").groupBy(F.col("doc").alias("_key")).agg(F.collect_list("line").alias("_lost"))
    lost = written(lost, "lost")
    dropped(shared)
    deleted(spark, [path])
    joined = docs.join(lost.hint("merge"), "_key", "left")  # one plan at every size
    told = joined.withColumn("_done", _without(chars)(F.when(F.col("_lost").isNotNull(), F.col("_text")), F.col("_lost")))
    whole, n = F.coalesce("_text", F.lit("")), F.coalesce(F.col("_done.n_dropped"), F.lit(0)).cast("long")
    out = told.select(
        F.col("_key").alias(key),
        F.col("_text").alias(text),
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        n.alias("n_dropped"),
        F.coalesce(F.col("_done.kept"), whole).alias("kept_text"),
    )
    return viewed(out, lost)
