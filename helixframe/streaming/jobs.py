"""Structured Streaming jobs over measurement and variant streams; each equals its batch counterpart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cohort import impact


def daily_mean(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(subject, day, mean, n) of closed days; rows later than the watermark are dropped.  Append mode."""
    windows = stream.withWatermark("ts", late).groupBy("subject", F.window("ts", "1 day").alias("w"))
    return windows.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select("subject", F.to_date("w.start").alias("day"), "mean", "n")


def running_burden(stream: DataFrame) -> DataFrame:
    """Mutations per sample so far.  Update or complete mode."""
    return stream.groupBy("sample_id").agg(F.count(F.lit(1)).alias("tmb"))


def annotated_variants(stream: DataFrame, drugs: DataFrame) -> DataFrame:
    """Arriving variants with impact and the number of drugs of their gene (a table read anew with each batch)."""
    by_gene = drugs.groupBy("gene").agg(F.count(F.lit(1)).alias("n_drugs"))
    return stream.withColumn("impact", impact(F.col("variant_class"))).join(by_gene, "gene", "left").fillna(0, ["n_drugs"])


#: Groups of subjects, by hash, whose switches are one state.
BUCKETS = 1024


class Hysteresis(StatefulProcessor):
    """On until below ``low``, off until above ``high``, per subject; a subject starts on.  State, per bucket of
    subjects: each one's switch and when it was last seen, so that a call works on all subjects of a bucket at once.

    With ``quiet``, a subject without rows for more than so many milliseconds of event time starts on again: the gap
    decides for a row, and the bucket's timer drops subjects once the watermark has passed their time, so that subjects
    which never come back are forgotten.
    """

    def __init__(self, low: float, high: float, quiet: int | None = None):
        self.low, self.high, self.quiet = low, high, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.switches = handle.getValueState("switches", T.StructType([T.StructField(c, T.BinaryType()) for c in ("subject", "on", "seen")]))

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subjects in order, switches, times."""
        raw = self.switches.get() if self.switches.exists() else (b"", b"", b"")
        return tuple(np.frombuffer(bytes(x), np.int64) for x in raw)

    def _keep(self, held: tuple[np.ndarray, ...], watermark: int) -> None:
        """Writes the bucket, without those whose time is over, and sets its timer to the next one's."""
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            until = held[2] // 1000 + self.quiet + 1
            held = tuple(x[until > watermark] for x in held)
            if len(held[0]):
                self.handle.registerTimer(int(until[until > watermark].min()))
        if len(held[0]):
            self.switches.update(tuple(x.astype(np.int64).tobytes() for x in held))
        else:
            self.switches.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame["subject"] = frame["subject"].astype("int64") if key[0] >= 0 else 0  # the bucket of rows without a subject
        frame = frame.sort_values(["subject", "ts", "ord"], kind="stable")
        subject, value = frame["subject"].to_numpy(), frame["value"].to_numpy()
        at = frame["ts"].to_numpy("datetime64[us]").astype("int64")
        first = np.flatnonzero(np.r_[True, subject[1:] != subject[:-1]])
        last = np.r_[first[1:], len(subject)] - 1
        held = self._held()
        place = np.searchsorted(held[0], subject[first])
        met = np.append(held[0], 0)[place] == subject[first]
        met &= place < len(held[0])
        on = np.where(met, np.append(held[1], 1)[place], 1)
        seen = np.where(met, np.append(held[2], 0)[place], at[first])
        signal = np.select([value < self.low, value > self.high], [0.0, 1.0], np.nan)
        if self.quiet is not None:
            before = np.r_[at[:1], at[:-1]]
            before[first] = seen
            signal[np.isnan(signal) & (at - before > self.quiet * 1000)] = 1.0
        signal[first] = np.where(np.isnan(signal[first]), on, signal[first])
        state = pd.Series(signal).ffill().to_numpy().astype("int32")
        others = ~np.isin(held[0], subject[first])
        new = (subject[first], state[last].astype(np.int64), np.where(met, np.maximum(at[last], seen), at[last]))
        merged = tuple(np.concatenate([a[others], b]) for a, b in zip(held, new, strict=True))
        order = np.argsort(merged[0], kind="stable")
        self._keep(tuple(x[order] for x in merged), timerValues.getCurrentWatermarkInMs() if self.quiet is not None else 0)
        yield pd.DataFrame({"subject": subject if key[0] >= 0 else None, "ord": frame["ord"].to_numpy(), "on": state})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def hysteresis_stream(stream: DataFrame, low: float, high: float, quiet: int | None = None, late: str = "1 day") -> DataFrame:
    """(subject, ord, on) of each row; ``quiet`` needs ``ts`` as event time, and drops rows later than the watermark."""
    rows = stream if quiet is None else stream.withWatermark("ts", late)
    bucket = F.when(F.col("subject").isNull(), -1).otherwise(F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Hysteresis(low, high, quiet), "subject long, ord long, on int", "Append", "None" if quiet is None else "EventTime")
