"""Streams of predictions and of new reports.

All jobs read with ``Trigger.AvailableNow`` unless told otherwise, keep their progress in a checkpoint
folder, and write each micro-batch to a folder named after its number: a batch that is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nosoflow.operators import monitor, reports
from nosoflow.operators.relational import first_per_key
from nosoflow.operators.scaling import lookup_join, ordinals

BATCH = "lot"
GROUP = "groupe"

#: Models of a batch for each group of tails, of which there are 2^LEAST_LEVEL at least; only the groups that a batch touches are read and rewritten.
GROUP_MODELS, LEAST_LEVEL = 16, 6


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append", wait: bool = True
) -> StreamingQuery:
    """Run ``step`` on every available micro-batch; a restart continues after the last finished one."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(step).trigger(availableNow=True).start()
    )
    if wait:
        query.awaitTermination()
    return query


def batch_folder(out: str, batch: int) -> str:
    return f"{out}/{BATCH}={batch}"


def count_windows(
    predictions: DataFrame, out: str, checkpoint: str, ts: str, by: Sequence[str], width: str, lateness: str
) -> StreamingQuery:
    """Counters per time window and model, updated as rows arrive; rows later than ``lateness`` are dropped.

    Counts are combined before the state store, so a busy model is one row per task and window. Each
    batch writes the windows it changed; ``latest_windows`` keeps the newest version of each.
    """
    counted = (
        predictions.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *by).agg(*monitor.counters())
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("debut"), *[c for c in batch.columns if c != "w"]).write.mode(
            "overwrite").parquet(batch_folder(out, number))

    return run_batches(counted, checkpoint, write, mode="update")


def latest_windows(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """Newest version of every window written by ``count_windows``."""
    return first_per_key(spark.read.parquet(out), ["debut", *by], [F.desc(BATCH)]).drop(BATCH)


def compact_windows(spark: SparkSession, out: str, target: str, by: Sequence[str]) -> None:
    """Write the newest version of every window to ``target``, as a batch before all others, for ``latest_windows`` to read.

    Run between two runs of ``count_windows``: later batches go to ``target``, and ``out`` may be deleted.
    """
    latest_windows(spark, out, by).write.mode("overwrite").parquet(batch_folder(target, -1))


def _newest_tails(spark: SparkSession, tails: str, number: int) -> dict[tuple[int, int], int]:
    """Last batch before ``number`` that wrote each group (level, group) of tails; from folder names, no file is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{tails}/{BATCH}=*/{GROUP}=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    newest: dict[tuple[int, int], int] = {}
    for status in found:
        batch, group = (x.split("=")[1] for x in status.getPath().toString().split("/")[-2:])
        level, place = (int(x) for x in group.split("-"))
        if int(batch) < number:
            newest[level, place] = max(newest.get((level, place), -1), int(batch))
    return newest


def _tail_folders(newest: dict[tuple[int, int], int], tails: str, level: int, touched: list[int]) -> list[str]:
    """Folder with the newest tails of each touched group. A group that no batch has written at this level is part of one of a lower level, whose file is read instead."""
    folders = {}
    for place in touched:
        known = [(newest[k, place % (1 << k)], k) for k in range(level + 1) if (k, place % (1 << k)) in newest]
        if known:
            batch, k = max(known)
            folders[f"{batch_folder(tails, batch)}/{GROUP}={k}-{place % (1 << k)}"] = None
    return list(folders)


def roll_latency(
    predictions: DataFrame, out: str, tails: str, checkpoint: str, by: Sequence[str], ts: str, event: str, latency: str,
    rows: int = monitor.WINDOW_ROWS,
) -> StreamingQuery:
    """Rolling mean and p95 over the last ``rows`` answers of each model, across micro-batches.

    Between batches only the last ``rows - 1`` answers per model are kept, as small tables by group of models; a batch reads and writes
    those of its own groups only. The number of groups follows the models: it doubles when a batch has more than ``GROUP_MODELS`` for each, and a group is then split
    when it is next touched. It is the batch operator over these tails and the new rows, so a busy model is spread over chunks
    instead of living in one state. A tail that a later batch has replaced is no longer read and may be deleted.
    """

    def step(batch: DataFrame, number: int) -> None:
        keep = [*by, ts, event, "_ms", "_arrival"]
        fresh = batch.where(~F.col("is_error")).withColumns({
            "_ms": monitor.exact_latency(F.col(latency)), "_arrival": F.lit(0).cast("bigint")})
        fresh = fresh.select(*keep).persist()
        both = fresh.withColumn("_new", F.lit(True))
        newest = _newest_tails(batch.sparkSession, tails, number)
        models = fresh.select(*by).distinct().persist()
        level = max([k for k, _ in newest] + [LEAST_LEVEL, (max(models.count() - 1, 0) // GROUP_MODELS).bit_length()])
        group = F.pmod(F.xxhash64(*by), F.lit(1 << level)).cast("int")
        touched = [r.g for r in models.select(group.alias("g")).distinct().collect()]  # a group for some models, as folder names
        if paths := _tail_folders(newest, tails, level, touched):
            tail = batch.sparkSession.read.parquet(*paths).select(*keep).withColumn("_new", F.lit(False))
            # a folder of a lower level holds models of groups that this batch does not touch: their tails stay there
            both = both.unionByName(lookup_join(tail.withColumn("_g", group), models.select(group.alias("_g")).distinct(), "_g", "left_semi").drop("_g"))
        # the tail comes first, in the order in which it was counted; a late row counts when it arrives
        slices = F.when(F.col("_new"), monitor.minutes(both, ts)).otherwise(F.lit(-(2**62)))
        order = ["_new", "_arrival", ts, event]
        numbered = ordinals(both, order, slices, by=by, name="position").persist()
        rolled = monitor.sliding(numbered, by, "position", rows).where("_new")
        result = monitor.finish_rolling(rolled).drop("_new", "_arrival", "position")
        result.write.mode("overwrite").parquet(batch_folder(out, number))
        last = first_per_key(numbered, by, [F.desc("position")], rows - 1)
        last = last.withColumn("_arrival", F.col("position")).select(*keep, F.concat(F.lit(f"{level}-"), group.cast("string")).alias(GROUP))
        last.write.mode("overwrite").partitionBy(GROUP).parquet(batch_folder(tails, number))
        for frame in (numbered, models, fresh):
            frame.unpersist()

    return run_batches(predictions, checkpoint, step)


def alert(predictions: DataFrame, out: str, checkpoint: str, text: str, keep: Sequence[str]) -> StreamingQuery:
    """Append the privacy-safe record of every prediction without main diagnosis."""
    query = (
        monitor.anomaly_log(predictions, text, keep).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _written_before(spark: SparkSession, path: str, number: int, asked: DataFrame, key: str, *more: str) -> DataFrame:
    """Keys of the batch ``asked`` that batches before ``number`` have written below ``path``. Only their columns are read, within the range of the keys."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    low, high = asked.agg(F.min(key), F.max(key)).first()
    if low is None or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return asked.select(key, *more).limit(0)
    earlier = spark.read.parquet(path).where((F.col(BATCH) < number) & F.col(key).between(F.lit(low), F.lit(high)))
    return lookup_join(earlier.select(key, *more), asked.select(key, *more).distinct(), [key, *more], "left_semi").distinct()


def take_in(new_reports: DataFrame, out: str, checkpoint: str, stays: DataFrame, codes: DataFrame) -> StreamingQuery:
    """Check arriving reports (with their ``diagnostics`` array) and write them to the tables below ``out``.

    An accepted report gives one row of ``crh`` and a row of ``diagnostic`` for each of its diagnoses, with the code's label; a refused one gives a row of
    ``refus`` with the reason. A report is taken in once: one whose id comes again, in the same batch or in a later one, however late, gives a row of ``rejoues`` instead. A
    refused report may come again and is checked again; the same refusal is noted once. The check runs once per batch. ``codes`` has ``code`` and ``libelle``; of several labels of a code the least is taken.
    """
    labels = codes.groupBy(F.col("code").alias("code_cim11")).agg(F.min("libelle").alias("libelle_saisi"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first, again = reports.one_delivery(batch)
        first = first.persist()
        known = _written_before(spark, f"{out}/crh", number, first, "id_crh").persist()
        fresh = lookup_join(first, known, "id_crh", "left_anti")
        diagnostics = fresh.select("id_crh", F.explode("diagnostics").alias("d")).select("id_crh", "d.*")
        checked = reports.check_intake(fresh, diagnostics, stays, codes).persist()
        accepted = checked.where(F.col("motif").isNull()).drop("motif")
        rows = accepted.select("id_crh", F.explode("diagnostics").alias("d")).select("id_crh", "d.*")
        refused = checked.where(F.col("motif").isNotNull()).select("id_crh", "motif")
        noted = _written_before(spark, f"{out}/refus", number, refused, "id_crh", "motif")
        repeated = [again.select("id_crh", F.lit("reçu deux fois dans le lot").alias("motif")), known.select("id_crh", F.lit("déjà enregistré").alias("motif"))]
        tables = {
            "crh": accepted.drop("diagnostics"), "diagnostic": lookup_join(rows, labels, "code_cim11", "left"),
            "refus": lookup_join(refused, noted, ["id_crh", "motif"], "left_anti"), "rejoues": repeated[0].unionByName(repeated[1])}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(batch_folder(f"{out}/{name}", number))
        for frame in (checked, known, first):
            frame.unpersist()

    return run_batches(new_reports, checkpoint, step)


def count_all_windows(
    predictions: DataFrame, out: str, checkpoint: str, ts: str, by: Sequence[str], width: str, lateness: str
) -> StreamingQuery:
    """Counters per time window and model that late rows correct.

    A window is closed once the newest time of earlier batches is ``lateness`` past its end. Each batch writes, below ``out``, what it adds to every window (``ajouts``),
    with ``apres_cloture`` true for what comes after the window was closed, and these late rows themselves with the reason (``retards``). ``corrected_windows`` adds
    up. What one batch adds is small, and a batch that is run again replaces its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/reperes")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            newest = spark.read.parquet(f"{out}/reperes").where(F.col(BATCH) < number).agg(F.max("repere").alias("m")).first().m  # one row per batch
        window = F.window(ts, width)
        late = F.lit(False) if newest is None else window["end"] <= F.lit(newest) - F.expr(f"INTERVAL {lateness}")
        rows = batch.withColumns({"debut": window["start"], "apres_cloture": late}).persist()
        added = rows.groupBy("debut", *by, "apres_cloture").agg(*monitor.counters())
        added.write.mode("overwrite").parquet(batch_folder(f"{out}/ajouts", number))
        reason = F.concat(F.lit("fenêtre close : "), F.col("debut").cast("string")).alias("motif")
        rows.where("apres_cloture").select(*batch.columns, reason).write.mode("overwrite").parquet(batch_folder(f"{out}/retards", number))
        rows.agg(F.max(ts).alias("repere")).write.mode("overwrite").parquet(batch_folder(f"{out}/reperes", number))
        rows.unpersist()

    return run_batches(predictions, checkpoint, step)


def corrected_windows(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """``debut``, ``by``, counters of all rows, and how many of the requests came after the window was closed."""
    added = spark.read.parquet(f"{out}/ajouts")
    counters = [c for c in added.columns if c.startswith("nb_")]
    late = F.sum(F.when(F.col("apres_cloture"), F.col("nb_requetes")).otherwise(0)).alias("nb_tardives")
    return added.groupBy("debut", *by).agg(*(F.sum(c).alias(c) for c in counters), late)
