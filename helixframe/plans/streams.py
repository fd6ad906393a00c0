"""Queries that run the streaming jobs to the end over the event table and return what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from ..streaming import jobs as J
from .base import query


def _events(v):
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{v.sf_dir}/event[s].parquet")


def _finished(v, stream, mode="append", root=None):
    """Runs all that is there into a table of files; with the ``root`` of an earlier run it goes on from there."""
    root = root or f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex[:10]}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.option("mergeSchema", "false").parquet(f"{root}/out")


@query("r1_daily_mean", "SELECT user_id AS subject, CAST(ts AS DATE) AS day, round(avg(value), 5) AS mean, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY 1, 2")
def r1(v):
    stream = _events(v).select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return _finished(v, J.daily_mean(stream)).select("subject", "day", F.round("mean", 5).alias("mean"), "n")


@query("r2_running_burden", "SELECT user_id AS sample_id, count(*) AS tmb FROM events GROUP BY 1")
def r2(v):
    out = _finished(v, J.running_burden(_events(v).select(F.col("user_id").alias("sample_id"))), "update")
    return out.groupBy("sample_id").agg(F.max("tmb").alias("tmb"))


@query("r3_annotated_variants", "WITH d AS (SELECT gene, count(*) AS n_drugs FROM drug_dim GROUP BY 1) SELECT v.gene, CASE WHEN variant_class IN ('Nonsense_Mutation','Splice_Site') THEN 'HIGH' WHEN variant_class = 'Missense_Mutation' THEN 'MODERATE' ELSE 'LOW' END AS impact, coalesce(any_value(n_drugs), 0) AS n_drugs, count(*) AS n FROM variants v LEFT JOIN d ON v.gene = d.gene GROUP BY 1, 2")
def r3(v):
    kind = F.create_map(*(F.lit(x) for p in {"purchase": "Missense_Mutation", "error": "Nonsense_Mutation", "view": "Silent", "click": "Splice_Site"}.items() for x in p))
    stream = _events(v).select(F.concat(F.lit("G"), (F.col("event_id") % 40).cast("string")).alias("gene"), F.coalesce(kind[F.col("event_type")], F.lit("RNA")).alias("variant_class"))
    return _finished(v, J.annotated_variants(stream, v.drug_dim)).groupBy("gene", "impact").agg(F.max("n_drugs").alias("n_drugs"), F.count(F.lit(1)).alias("n"))


#: Hours without a row after which a subject starts on again.
QUIET = 18


@query("r4_hysteresis", f"WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT user_id, last_value(CASE WHEN value < 20 THEN 0 WHEN value > 60 THEN 1 WHEN before IS NULL OR ts - before > INTERVAL {QUIET} HOUR THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM l) SELECT user_id AS subject, CAST(sum(o) AS BIGINT) AS n_on, count(*) AS n FROM s GROUP BY 1")
def r4(v):
    """The events arrive in four parts, one after the other; the watermark passes quiet subjects' timers in between."""
    rows = v.events.select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), "value")
    second = F.unix_seconds("ts")
    cuts = rows.select(F.percentile_approx(second, [0.25, 0.5, 0.75]).alias("c")).first()["c"]
    root = f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex[:10]}"
    # This kind of state needs the RocksDB store; the session's own choice comes back afterwards.
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = v.spark.conf.get(name)
    v.spark.conf.set(name, store)
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows.where((second > low if low is not None else F.lit(True)) & (second <= high if high is not None else F.lit(True)))
            part.write.mode("append").parquet(f"{root}/in")
            stream = v.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            done = _finished(v, J.hysteresis_stream(stream, 20, 60, quiet=QUIET * 3_600_000, late="0 seconds"), root=root)
    finally:
        v.spark.conf.set(name, before)
    return done.groupBy("subject").agg(F.sum("on").alias("n_on"), F.count(F.lit(1)).alias("n"))
