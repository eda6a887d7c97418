"""Structured Streaming versions of what is watched over time.

Every operator takes a batch or a streaming DataFrame. Event time is ``ts``; the watermark is ten minutes by default, and
rows that come later are dropped from the state.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def _timed(df: DataFrame) -> DataFrame:
    """``df`` with ``ts`` as a timestamp with the session's zone, which watermarks need."""
    return df if dict(df.dtypes)["ts"] == "timestamp" else df.withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(df: DataFrame, watermark: str) -> DataFrame:
    return _timed(df).withWatermark("ts", watermark) if df.isStreaming else _timed(df)


def windowed(df: DataFrame, size: str = "1 hour", slide: str | None = None, *, key: str = "event_type", value: str = "value", watermark: str = WATERMARK) -> DataFrame:
    """``key, start, end, n, total, mean, least, most`` in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    x = F.col(value)
    return _marked(df, watermark).groupBy(key, w.alias("w")).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "mean", "least", "most")


def sessions(df: DataFrame, gap: str = "30 minutes", *, key: str = "user_id", watermark: str = WATERMARK) -> DataFrame:
    """``key, start, end, n``: runs of events with no longer pause than ``gap``."""
    return _marked(df, watermark).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def requests(df: DataFrame, size: str = "1 hour", *, failed, slow: float, value: str = "value", watermark: str = WATERMARK) -> DataFrame:
    """``start, total, errors, slow_count, error_percent, p95`` by window."""
    a = _marked(df, watermark).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"), F.count_if(F.col(value) > slow).alias("slow_count"), F.percentile_approx(value, 0.95).alias("p95"))
    return a.select(F.col("w.start").alias("start"), "total", "errors", "slow_count", (100.0 * F.col("errors") / F.col("total")).alias("error_percent"), "p95")


def quality(df: DataFrame, columns: list[str], size: str = "1 day", *, watermark: str = WATERMARK) -> DataFrame:
    """``start, n, missing_ratio, distinct_ratio`` by window; distinct rows by a sketch of bounded size."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    a = _marked(df, watermark).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), missing.alias("m"), F.approx_count_distinct(F.xxhash64(*columns)).alias("u"))
    return a.select(F.col("w.start").alias("start"), "n", (F.col("m") / (F.col("n") * len(columns))).alias("missing_ratio"), F.least(F.lit(1.0), F.col("u") / F.col("n")).alias("distinct_ratio"))


def bucket_counts(df: DataFrame, edges: list[float], size: str = "1 day", *, value: str = "value", watermark: str = WATERMARK) -> DataFrame:
    """``start, bin, n``: values counted in the bins of a reference, by window; null bin for values outside."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value)))
    bin_ = F.when((at > 0) & (at < len(edges)), at)
    return _marked(df, watermark).groupBy(F.window("ts", size).alias("w"), bin_.alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def window_psi(counts: DataFrame, shares: list[float], least: int = 100, floor: float = 0.001) -> DataFrame:
    """``start, n, psi``: stability of each window's bin counts against reference shares, from ``least`` values on."""
    ref = F.create_map(*[F.lit(x) for i, s in enumerate(shares, 1) for x in (i, max(float(s), floor))])
    total = counts.groupBy("start").agg(F.sum("n").alias("all_"))
    every = total.where(F.col("all_") >= least).crossJoin(F.broadcast(counts.sparkSession.range(1, len(shares) + 1).select(F.col("id").cast("int").alias("bin"))))
    joined = every.join(counts.where("bin IS NOT NULL"), ["start", "bin"], "left")
    c, r = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("all_"), F.lit(floor)), F.element_at(ref, F.col("bin"))
    return joined.groupBy("start").agg(F.first("all_").alias("n"), F.sum((c - r) * F.ln(c / r)).alias("psi"))


def deduplicated(df: DataFrame, keys: list[str], *, watermark: str = WATERMARK) -> DataFrame:
    """Rows without repeats of the same keys: within the watermark in a stream, the first in time in a batch.

    Of rows at the same time the batch takes the smallest by the other columns.
    """
    if df.isStreaming:
        return _marked(df, watermark).dropDuplicatesWithinWatermark(keys)
    rest = [c for c, kind in df.dtypes if c not in keys and c != "ts" and "map<" not in kind]
    w = Window.partitionBy(*keys).orderBy("ts", *rest)
    return df.withColumn("i_", F.row_number().over(w)).where("i_ = 1").drop("i_")


def enriched(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Rows with static features of their key (stream-static left join)."""
    return df.join(features, key, "left")


_ALERT = "key string, ts timestamp, score double"


def limited_alerts(df: DataFrame, *, cooldown_seconds: int = 3600, daily: int = 50, watermark: str = WATERMARK) -> DataFrame:
    """``key, ts, score`` of the alerts (key, ts, score) to send: none of a key within the cooldown of one sent before, and
    at most ``daily`` of a key a day (UTC). Alerts sent count, not alerts detected.

    A stream keeps the last sent time and the day's count for each key and forgets them after a day without alerts.
    """

    def send(pdf: pd.DataFrame, last: float, day: int, count: int):
        kept = []
        for row in pdf.itertuples(index=False):
            at = row.ts.timestamp()
            if int(at // 86_400) != day:
                day, count = int(at // 86_400), 0
            if at - last >= cooldown_seconds and count < daily:
                kept.append((row.key, row.ts, row.score))
                last, count = at, count + 1
        return pd.DataFrame(kept, columns=["key", "ts", "score"]), last, day, count

    rows = _timed(df).select(F.col("key").cast("string").alias("key"), "ts", F.col("score").cast("double").alias("score"))
    if not df.isStreaming:
        # sorted by Spark, which can spill; a task holds one batch and the state of the key it is at
        def walk(batches):
            at, state = None, (-1e18, -1, 0)
            for pdf in batches:
                for _, run in pdf.groupby((pdf["key"] != pdf["key"].shift()).cumsum(), sort=False):
                    key = run["key"].iloc[0]
                    if key != at:
                        at, state = key, (-1e18, -1, 0)
                    out, *state = send(run, *state)
                    yield out

        return rows.repartition("key").sortWithinPartitions("key", "ts", "score").mapInPandas(walk, _ALERT)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, day, count = state.get if state.exists else (-1e18, -1, 0)
        out, last, day, count = send(pd.concat(list(frames)).sort_values(["ts", "score"]), last, day, count)
        state.update((last, day, count))
        state.setTimeoutTimestamp(max(int(state.getCurrentWatermarkMs()), int(last * 1000)) + 86_400_000)
        yield out

    return rows.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(step, _ALERT, "last double, day int, count int", "append", "EventTimeTimeout")


def scored(df: DataFrame, model) -> DataFrame:
    """Rows scored by a fitted pipeline, in a batch or a stream."""
    return model.transform(df)


def retained(df: DataFrame, days: int, now=None) -> DataFrame:
    """Rows not older than ``days`` before ``now``."""
    return df.where(F.col("ts") >= (F.lit(now) if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS"))


def ingest(stream: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame]) -> None:
    """Every new file once: rows under ``target``, and what ``each`` reports of a batch under ``target`` + ``_profile``.

    A batch has a folder of its own (the column ``batch``), which a batch that is run again overwrites.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")
        each(df).write.mode("overwrite").parquet(f"{target}_profile/batch={number}")
        df.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there now, as a table."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target)
