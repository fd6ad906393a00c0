"""Where intermediate tables go, and how the standard tables are read."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: list[list[str]] = []
#: Folders of applications that are deleted when the driver ends.
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error, because a
    machine-local folder would be invisible to the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; ``collected`` lists it.

    What is still there when the driver ends is deleted then: a query's result may read its tables until that time.
    """
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _FOLDERS.add(folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex[:12]}"
    for paths in _OPEN:
        paths.append(path)
    return path


def written(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors.

    Spark's reader decodes up to 4,096 rows of a row group at once; ``group_rows`` bounds them where rows are large.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder, if they are still there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave and that nothing will read again."""
    for t in tables:
        if t is not None and (path := _PATHS.pop(t, None)):
            deleted(t.sparkSession, [path])


def viewed(view: DataFrame, of: DataFrame) -> DataFrame:
    """``view`` only picks and renames columns of the written table ``of`` and is dropped in its place."""
    if of in _PATHS:
        _PATHS[view] = _PATHS[of]
    return view


@contextmanager
def collected() -> Iterator[list[str]]:
    """Lists the paths of all tables written inside, so that ``deleted`` can remove them once the result is stored."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unclaimed(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own, like ``wanted``, that no input column has, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the map that tells which keys may occur in a list: its size doesn't depend on the data.
KEY_BITS = 1 << 24


def may_occur(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: false where ``key`` surely isn't in the table ``keys`` (one column), so that rows without a
    partner needn't be shuffled for a join.  A bit map of the keys' hashes, ``KEY_BITS`` / 64 rows at most, is broadcast.
    """
    at, word, bits = unclaimed(rows.columns, "at", "word", "bits")
    own = keys.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(KEY_BITS))
    bit = F.expr(f"shiftleft(1L, CAST({at} % 64 AS INT))")
    words = keys.select(slot(own).alias(at)).groupBy(F.expr(f"{at} div 64").alias(word)).agg(F.bit_or(bit).alias(bits))
    told = rows.withColumn(at, slot(key)).withColumn(word, F.expr(f"{at} div 64")).join(F.broadcast(words), word, "left")
    met = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return told.withColumn(flag, met).drop(at, word, bits)


def swept(spark: SparkSession) -> None:
    """Lets the driver collect garbage: Spark then deletes the shuffle files of tables that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()
