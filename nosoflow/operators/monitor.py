"""Prediction metrics: counters, rolling latency, latest points, privacy-safe anomaly log."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.functions.text import fingerprint
from nosoflow.operators.relational import first_per_key
from nosoflow.operators.scaling import ordinals

# Latencies kept, percentile and the fewest values it needs, points shown.
WINDOW_ROWS = 200
P95, P95_MIN = 0.95, 5
SHOWN_POINTS = 50


def counters() -> list[Column]:
    """Requests, errors, and predictions without main diagnosis. An error gives no prediction."""
    return [
        F.count(F.lit(1)).alias("nb_requetes"),
        F.count_if("is_error").alias("nb_erreurs"),
        F.count_if(F.col("dp_missing") & ~F.col("is_error")).alias("nb_anomalies_dp_manquant"),
    ]


def request_counters(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(*counters())


def exact_latency(latency: Column) -> Column:
    """Milliseconds as decimal: sums do not depend on the order of rows, and halves round up."""
    return latency.cast("decimal(18,4)")


def sliding(numbered: DataFrame, by: Sequence[str], position: str, rows: int = WINDOW_ROWS, chunk: int = 10_000) -> DataFrame:
    """``numbered`` with the number, sum and nearest-rank p95 of ``_ms`` over the last ``rows`` rows of the group, ``_n``, ``_sum``, ``_p95``; null values are passed over.

    Every group is cut into chunks of ``chunk`` positions; the last ``rows - 1`` rows of a chunk are repeated at the head of the next one, so a busy group is spread over
    many tasks. A task goes through its rows in order and keeps the window's values sorted: one comes in and one goes out by bisection.
    """
    own = F.floor((F.col(position) - 1) / chunk)
    offset = F.pmod(F.col(position) - 1, F.lit(chunk))
    homes = F.when(offset >= chunk - (rows - 1), F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumns({"_units": (F.col("_ms") * 10_000).cast("bigint"), "_own": own}).withColumn("_chunk", F.explode(homes))
    dealt = spread.repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", position)
    kept = [c for c in spread.columns if c not in ("_units", "_own", "_chunk")]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, window, ordered, total = None, deque(), [], 0
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in [*by, "_chunk"]))
            mine = pc.equal(batch.column("_own"), batch.column("_chunk"))
            counts, sums, ranks = [], [], []
            for key, units, shown in zip(keys, batch.column("_units").to_pylist(), mine.to_pylist()):
                if key != owner:
                    owner, window, ordered, total = key, deque(), [], 0
                window.append(units)
                if units is not None:
                    insort(ordered, units)
                    total += units
                gone = window.popleft() if len(window) > rows else None
                if gone is not None:
                    del ordered[bisect_left(ordered, gone)]
                    total -= gone
                if shown:
                    n = len(ordered)
                    counts.append(n)
                    sums.append(Decimal(total) if n else None)
                    ranks.append(ordered[max(int(n * P95), 1) - 1] if n >= P95_MIN else None)
            columns = [batch.column(c).filter(mine) for c in kept]
            found = [pa.array(counts, pa.int64()), pa.array(sums, pa.decimal128(28, 0)), pa.array(ranks, pa.int64())]
            yield pa.record_batch([*columns, *found], names=[*kept, "_n", "_total", "_rank"])

    schema = T.StructType([*(spread.schema[c] for c in kept), T.StructField("_n", T.LongType()), T.StructField("_total", T.DecimalType(28, 0)), T.StructField("_rank", T.LongType())])
    unit = F.lit(Decimal("0.0001"))
    return dealt.mapInArrow(slide, schema).withColumns({
        "_sum": (F.col("_total") * unit).cast("decimal(28,4)"), "_p95": (F.col("_rank").cast("decimal(20,0)") * unit).cast("decimal(18,4)")}).drop("_total", "_rank")


def finish_rolling(df: DataFrame) -> DataFrame:
    mean = F.col("_sum") / F.col("_n").cast("decimal(10,0)")
    return df.withColumns({
        "fenetre_glissante": F.col("_n"),
        "latence_moyenne_ms": F.round(mean, 1).cast("double"),
        "latence_p95_ms": F.round("_p95", 1).cast("double"),
    }).drop("_n", "_sum", "_p95", "_ms")


def minutes(df: DataFrame, ts: str) -> Column:
    """Minute number of a timestamp, increasing with it whatever the session's time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        return day * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.floor(F.unix_micros(F.col(ts)) / 60_000_000)


def rolling_latency(
    predictions: DataFrame, by: Sequence[str], ts: str, event: str, latency: str, rows: int = WINDOW_ROWS
) -> DataFrame:
    """Mean and nearest-rank p95 over the last ``rows`` answered requests, after each of them.

    Positions per model come from minute counts and windows slide over bounded chunks, so a model
    with a third of the traffic is spread over many tasks.
    """
    answered = predictions.where(~F.col("is_error")).withColumn("_ms", exact_latency(F.col(latency)))
    numbered = ordinals(answered, [ts, event], minutes(answered, ts), by=by, name="position")
    return finish_rolling(sliding(numbered, by, "position", rows))


def latest_points(predictions: DataFrame, by: Sequence[str], ts: str, event: str, k: int = SHOWN_POINTS) -> DataFrame:
    """Last ``k`` rows per model. Map tasks pass on at most ``k`` rows per model."""
    return first_per_key(predictions, by, [F.desc(ts), F.desc(event)], k)


def anomaly_log(predictions: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Predictions without main diagnosis: length and fingerprint of the text, never the text."""
    missing = predictions.where(F.col("dp_missing") & ~F.col("is_error"))
    return missing.select(
        *keep, F.length(text).cast("bigint").alias("longueur_crh"), fingerprint(F.col(text)).alias("empreinte"))
