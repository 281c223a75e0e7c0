"""Structured Streaming jobs: ingest, live feed, running counts, enrichment (S8, T)."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netlantern.functions.times import bucket_width
from netlantern.operators.enrich import (
    enrich_events,
    pending_ips,
    resolve_intel,
)
from netlantern.operators.parse import parse_syslog
from netlantern.operators.stats import is_type
from netlantern.plans.sizing import is_small, written_once
from netlantern.plans.topk import sequence_rows
from netlantern.schema import EVENT_TYPES, TIMELINE_TYPES
from netlantern.sources.intel import append_intel, read_intel
from netlantern.sources.store import append_events, complete, with_raw

# How often each job runs, and the pseudo type of an unlisted event type.
INGEST_EVERY, FEED_EVERY, COUNTS_EVERY = "500 milliseconds", "100 milliseconds", "5 seconds"
OTHER_TYPE = "*"
SALTS = 256


def _start(writer, every: str | None) -> StreamingQuery:
    """Start on a processing-time trigger, or once over everything available (``every=None``)."""
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()


def parsed_stream(lines: DataFrame, keep_raw: bool = False) -> DataFrame:
    return with_raw(parse_syslog(lines), keep_raw)


def _batch_name(kind: str, checkpoint: str, epoch: int) -> str:
    """The same for a repeated batch of a stream, and no other stream's."""
    return f"{kind}-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}-{epoch}"


def start_ingest(
    lines: DataFrame, path: str, checkpoint: str, every: str | None = INGEST_EVERY,
    keep_raw: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Parse lines and append events by day (T1). A repeated batch replaces itself, also after its days
    were rewritten, and batch writers may add to the same table. Batches are known by ``name``, the
    checkpoint's by default: a stream that starts over under its old name adds nothing twice, if its
    batches are those it had."""

    placed = bool({"id", "offset"} & set(lines.columns))

    def save(batch: DataFrame, epoch: int) -> None:
        own = _batch_name("ingest", name or checkpoint, epoch)
        if not placed:
            place = F.monotonically_increasing_id()
            batch = batch.withColumn("id", F.xxhash64("id", F.lit(own), place))
        append_events(batch, path, batch=own)

    writer = parsed_stream(lines, keep_raw).writeStream.foreachBatch(save)
    return _start(writer.option("checkpointLocation", checkpoint), every)


def stream_type_counts(ev: DataFrame) -> DataFrame:
    """Running count by event type (T2); state of one row per type."""
    return ev.groupBy("event_type").agg(F.count("*").alias("count"))


def stream_timeline(ev: DataFrame, bucket: str, delay: str) -> DataFrame:
    """Running timeline (T4): buckets close ``delay`` after their end."""
    return (
        ev.withWatermark("received_at", delay)
        .groupBy(F.window("received_at", bucket_width(bucket)))
        .agg(
            *[F.count_if(is_type(t)).alias(t) for t in TIMELINE_TYPES],
            F.count("*").alias("total"),
        )
        .select(F.col("window.start").alias("ts"), *TIMELINE_TYPES, "total")
    )


def start_timeline(
    ev: DataFrame, bucket: str, delay: str, path: str, checkpoint: str, every: str | None = COUNTS_EVERY
) -> StreamingQuery:
    """Timeline of a stream with rows that come too late set apart (T4).

    A batch's rows are late when they are older than the newest event of the batches before by more than
    ``delay``. Counts of the others are added to their buckets, and late rows are kept as they are, so none
    is lost: read both with :func:`read_timeline` and :func:`read_late`. A bucket that ends before that
    limit is closed. Each batch writes folders of its own, which a repeated batch replaces, and one row with
    the newest event time so far.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = F.lit(_newest_before(spark, path, epoch)).cast("timestamp")
        limit = before - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("received_at") < limit, F.lit(False))
        with written_once(batch, "arrived") as rows:
            newest = rows.agg(F.greatest(F.max("received_at"), before).alias("newest"))
            counts = timeline_counts(rows.filter(~late), bucket)
            counts.write.mode("overwrite").parquet(f"{path}/counts/version={epoch}")
            rows.filter(late).write.mode("overwrite").parquet(f"{path}/late/version={epoch}")
            newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/version={epoch}")

    writer = ev.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return _start(writer, every)


def timeline_counts(ev: DataFrame, bucket: str) -> DataFrame:
    return ev.groupBy(F.window("received_at", bucket_width(bucket)).getField("start").alias("ts")).agg(
        *[F.count_if(is_type(t)).alias(t) for t in TIMELINE_TYPES], F.count("*").alias("total")
    )


def _newest_before(spark: SparkSession, path: str, epoch: int) -> dt.datetime | None:
    """The newest event time of the batches before this one, as the last of them left it."""
    if not epoch:
        return None
    schema = "newest TIMESTAMP"
    return spark.read.schema(schema).parquet(f"{path}/newest/version={epoch - 1}").first().newest


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Counts by bucket of all rows that came in time."""
    rows = spark.read.parquet(f"{path}/counts")
    return rows.groupBy("ts").agg(*[F.sum(c).alias(c) for c in (*TIMELINE_TYPES, "total")])


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the batch in which they did."""
    return spark.read.parquet(f"{path}/late")


def start_table(
    result: DataFrame, path: str, checkpoint: str, mode: str, every: str | None
) -> StreamingQuery:
    """Write each batch of an aggregated stream to its own folder, so a repeated batch replaces
    itself. Read it back with :func:`read_table`. A complete result makes all but the version
    before it superfluous, so they go."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        if mode == "complete" and epoch > 1:
            spark = batch.sparkSession
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = (
        result.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, every)


def read_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key of a table written by :func:`start_table`."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "version")]
    newest = F.max_by(F.struct(*values), "version").alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


# ---------------------------------------------------------------- live feed
def match_subscriptions(ev: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event once per subscriber that wants it.

    ``subscriptions(sub_id, event_types, action)``: no types means all, no action means any. A
    subscription becomes one row per wanted type, so this is a join on the type. The list is
    broadcast when it is small; a long one is copied to each of a fixed number of salts, so that
    the dominant event type spreads over as many tasks.
    """
    anything = F.coalesce(F.size("event_types"), F.lit(0)) <= 0
    every_type = F.array(*[F.lit(t) for t in [*EVENT_TYPES, OTHER_TYPE]])
    wanted = subscriptions.select(
        "sub_id",
        F.explode(F.when(anything, every_type).otherwise(F.array_distinct("event_types"))).alias(
            "_type"
        ),
        F.nullif("action", F.lit("")).alias("_action"),
    )
    type_key = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise(
        F.lit(OTHER_TYPE)
    )
    rows = ev.withColumn("_key", type_key)
    on = F.col("_key") == F.col("_type")
    if is_small(wanted):
        wanted = F.broadcast(wanted)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        wanted = wanted.withColumn("_copy", F.explode(salts))
        on = on & (F.col("_salt") == F.col("_copy"))
    any_action = F.col("_action").isNull()
    return (
        rows.join(wanted, on)
        .filter(any_action | (F.col("action") == F.col("_action")))
        .select("sub_id", *ev.columns)
    )


def _feed_before(spark: SparkSession, path: str, epoch: int) -> int:
    """Highest sequence number of the batches before this one: that of the last one with rows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for before in range(epoch - 1, -1, -1):
        folder = f"{path}/version={before}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
            top = spark.read.schema("seq BIGINT").parquet(folder).agg(F.max("seq")).first()[0]
            if top is not None:
                return top
    return 0


def live_feed(
    ev: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str,
    every: str | None = FEED_EVERY,
) -> StreamingQuery:
    """Feed of events to subscribers, in order, with a running sequence number."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        order = ["received_at", "id", "sub_id"]
        with written_once(match_subscriptions(batch, subscriptions), "matched") as matched:
            numbered = sequence_rows(matched, order, "seq", _feed_before(spark, path, epoch))
            numbered.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    writer = ev.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return _start(writer, every)


# ---------------------------------------------------------------- enrichment on arrival
def stream_enrich(
    ev: DataFrame, load_intel: Callable[[], DataFrame], path: str, checkpoint: str,
    every: str | None = INGEST_EVERY,
) -> StreamingQuery:
    """Enrich events as they arrive and append them to an event table (T5); the intelligence table is
    read anew for each batch."""

    def save(batch: DataFrame, epoch: int) -> None:
        # Lookups in a large table read the batch several times, but its lines are parsed once.
        with written_once(complete(batch), "arrived") as rows:
            enriched = enrich_events(rows, load_intel())
            append_events(enriched, path, batch=_batch_name("enrich", checkpoint, epoch))

    writer = ev.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return _start(writer, every)


def enrich_batch(
    batch: DataFrame,
    epoch: int,
    intel_path: str,
    as_of: dt.datetime | str,
    **sources: DataFrame | None,
) -> DataFrame:
    """Find the batch's pending addresses, look them up, and log the result.

    Version ``epoch`` is derived only from earlier versions and replaces itself when a batch is
    repeated. Older events are filled by a scheduled :func:`enrich_events`.
    """
    spark = batch.sparkSession
    known = read_intel(spark, intel_path, before=epoch)
    pending = pending_ips(batch, known, as_of)
    append_intel(resolve_intel(pending, known, as_of, **sources), intel_path, epoch)
    return read_intel(spark, intel_path, before=epoch + 1)


def start_enrichment(
    ev: DataFrame, intel_path: str, as_of: dt.datetime | str | None, checkpoint: str,
    every: str | None = INGEST_EVERY, **sources: DataFrame | None,
) -> StreamingQuery:
    """Run :func:`enrich_batch` on every batch; without ``as_of`` the clock of the batch counts.

    Epoch 0 of the log is the table the job starts from, so batches are numbered from 1.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        now = as_of or dt.datetime.now(dt.timezone.utc)
        enrich_batch(batch, epoch + 1, intel_path, now, **sources)

    writer = ev.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _start(writer, every)
