"""The stored event table: append, scan, raw-text policy, retention, rewriting of days.

Layout: ``event_date=YYYY-MM-DD/gen=N/batch=NAME/*.parquet``. Days are UTC days. Every writer, batch or
stream, adds folders of its own name to the generation of a day that counts, so all of them can share a
table, and a batch that is written again replaces itself.

A rewrite of a day (retention, compaction, backfill) writes the next generation beside the one that
counts: all its rows in one folder, each with the batch it came from, and last a list of the batches that
are in it. Before the list is there nobody looks at the new generation; from then on the listed batches of
older generations don't count any more. Batches that arrive meanwhile are not in the list, so they count
wherever they are, and a listed batch that is written again hides the rows it left in the merged folder.
Old generations stay until the next maintenance, for those who still read them. Days are maintained by one
job at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.functions.times import instant, parse_instant, utc_day
from netlantern.schema import EVENT_SCHEMA

DAY, GEN, BATCH, ORIGIN = "event_date", "gen", "batch", "origin"
STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField(DAY, T.DateType())])
#: As stored: the batch of a row in a merged folder, and the folders as columns.
FOLDER_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField(ORIGIN, T.StringType()),
        T.StructField(DAY, T.DateType()),
        T.StructField(GEN, T.IntegerType()),
        T.StructField(BATCH, T.StringType()),
    ]
)
RETENTION_DAYS = 60
LOOKED_UP = ("id", "src_ip", "dst_ip", "client_mac", "wifi_client_mac", "dhcp_mac", "mac_src", "mac_dst")
#: The folder of a rewritten day, and the list that makes it count. Spark doesn't read names that begin
#: with an underscore.
MERGED, LISTED, END = "merged", "_batches", "#end"


def with_raw(ev: DataFrame, keep: bool = False) -> DataFrame:
    """Keep or drop the raw text of each event (S3); the default drops it."""
    return ev if keep else ev.withColumn("raw_message", F.lit(None).cast("string"))


def complete(ev: DataFrame) -> DataFrame:
    """All event columns in storage order; a column the input lacks is NULL."""
    have = set(ev.columns)
    return ev.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ]
    )


def stored_form(ev: DataFrame) -> DataFrame:
    return complete(ev).withColumn(DAY, utc_day(F.col("received_at")))


def append_events(
    ev: DataFrame, path: str, bulk: bool = False, batch: str | None = None
) -> None:
    """Write events under ``path``, one folder per UTC day and batch.

    A batch name that was used before replaces what it wrote; without one the rows are added. A
    micro-batch holds about one day and is written as it is. A bulk load spans many days: it is
    rebalanced by day first (adaptive execution splits days that are too big for one task and merges
    small ones), so that it does not leave one small file per task and day. Rows are sorted within
    files, which lets later scans skip row groups by type and time; addresses, MACs and ids, which no
    order serves, have Bloom filters.
    """
    spark = ev.sparkSession
    counting = {day: max(gens) for day, gens in _generations(spark, path).items() if max(gens)}
    stored = stored_form(ev).withColumn(GEN, _by_day(counting))
    stored = stored.withColumn(BATCH, F.lit(batch or f"append-{uuid.uuid4().hex}"))
    if bulk:
        stored = stored.hint("rebalance", DAY)
    _write(stored.sortWithinPartitions(DAY, "event_type", "received_at"), path)


def _write(stored: DataFrame, path: str) -> None:
    writer = stored.write
    for name in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy(DAY, GEN, BATCH).option("partitionOverwriteMode", "dynamic").mode(
        "overwrite"
    ).parquet(path)


def _by_day(numbers: dict[dt.date, int]) -> Column:
    if not numbers:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for pair in sorted(numbers.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, F.col(DAY)), F.lit(0))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the event table (S4); conditions on ``event_date`` prune whole folders.

    Which folders count is looked up now; rewrites that end later don't touch them.
    """
    return stored_rows(spark, path).select(*STORED_SCHEMA.names)


def stored_rows(spark: SparkSession, path: str, days: Iterable[Day] | None = None) -> DataFrame:
    """The same with each row's folder, of all days or those given."""
    if days is None:
        if all(gens == [0] for gens in _generations(spark, path).values()):
            # A rewrite may end before the files are listed.
            return spark.read.schema(FOLDER_SCHEMA).parquet(path).filter(F.col(GEN) == 0)
        days = counting_days(spark, path)
    days = list(days)
    folders = [f"{path}/{folder}" for d in days for folder in d.folders]
    if not folders:
        return spark.createDataFrame([], FOLDER_SCHEMA)
    rows = spark.read.schema(FOLDER_SCHEMA).option("basePath", path).parquet(*folders)
    for d in days:
        if d.again:
            hidden = (F.col(DAY) == F.lit(d.day)) & (F.col(BATCH) == MERGED) & F.col(ORIGIN).isin(d.again)
            rows = rows.filter(~F.coalesce(hidden, F.lit(False)))
    return rows


def retention_cutoff(as_of: dt.datetime | str, days: int = RETENTION_DAYS) -> dt.datetime:
    return parse_instant(as_of) - dt.timedelta(days=days)


def apply_retention(
    ev: DataFrame, as_of: dt.datetime | str, days: int = RETENTION_DAYS
) -> DataFrame:
    """Events that stay: received no earlier than ``days`` before ``as_of`` (M1)."""
    return ev.filter(F.col("received_at") >= instant(retention_cutoff(as_of, days)))


def retention_report(
    ev: DataFrame, as_of: dt.datetime | str, days: int = RETENTION_DAYS
) -> DataFrame:
    """One row: how many events stay and how many are deleted."""
    stays = F.col("received_at") >= instant(retention_cutoff(as_of, days))
    return ev.agg(
        F.count_if(stays).alias("kept"), F.count_if(~stays).alias("deleted")
    )


def run_retention(
    spark: SparkSession, path: str, as_of: dt.datetime | str, days: int = RETENTION_DAYS
) -> int:
    """Delete old events from a stored table; returns how many.

    Earlier days are dropped as whole folders; only the day the cutoff falls into is rewritten. A run
    that was cut short can be repeated.
    """
    cutoff = retention_cutoff(as_of, days)
    clean_days(spark, path)
    old_days = read_events(spark, path).filter(F.col(DAY) <= F.lit(cutoff.date()))
    deleted = old_days.filter(F.col("received_at") < instant(cutoff)).count()
    if deleted:
        stays = F.col("received_at") >= instant(cutoff)
        rewrite_days(spark, path, [cutoff.date()], lambda ev: ev.filter(stays))
        files, root = _folder(spark, path)
        for day in stored_days(spark, path):
            if day < cutoff.date():
                files.delete(_child(spark, root, f"{DAY}={day}"), True)
    return deleted


# ---------------------------------------------------------------- days and their generations
@dataclass
class Day:
    """A day as it counts now. Folders are relative to the table."""

    day: dt.date
    gen: int
    folders: list[str] = field(default_factory=list)
    #: Batches that count, and those of them that were written again after a merge.
    batches: set[str] = field(default_factory=set)
    again: list[str] = field(default_factory=list)
    #: Folders that no longer count, and generations that never did.
    stale: list[str] = field(default_factory=list)


def _generations(spark: SparkSession, path: str) -> dict[dt.date, list[int]]:
    """The finished generations of each day, rising; the first needs no list."""
    files, root = _folder(spark, path)
    found: dict[dt.date, list[int]] = {}
    for status in files.globStatus(_child(spark, root, f"{DAY}=*/{GEN}=*")) or []:
        folder = status.getPath()
        day = dt.date.fromisoformat(folder.getParent().getName().split("=", 1)[1])
        gen = int(folder.getName().split("=", 1)[1])
        gens = found.setdefault(day, [0])
        if gen and _listed(spark, files, folder) is not None:
            gens.append(gen)
    return {day: sorted(gens) for day, gens in found.items()}


def _listed(spark: SparkSession, files, folder) -> set[str] | None:
    """The batches merged in a finished generation."""
    name = _child(spark, folder, LISTED)
    if not files.exists(name):
        return None
    data = files.open(name)
    lines = bytes(data.readAllBytes()).decode().split("\n")
    data.close()
    return set(lines[:-1]) if lines[-1] == END else None


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that have a folder, in order."""
    return sorted(_generations(spark, path))


def counting_days(spark: SparkSession, path: str) -> list[Day]:
    """What counts of each day, in order."""
    files, root = _folder(spark, path)
    out = []
    for day, gens in sorted(_generations(spark, path).items()):
        found = Day(day, gens[-1])
        listed: set[str] = set()
        folder = _child(spark, root, f"{DAY}={day}")
        present = [s.getPath().getName() for s in files.listStatus(folder)]
        numbers = sorted(int(n.split("=", 1)[1]) for n in present if n.startswith(f"{GEN}="))
        for gen in reversed(numbers):
            own = f"{DAY}={day}/{GEN}={gen}"
            if gen not in gens:
                found.stale.append(own)
                continue
            merged = _listed(spark, files, _child(spark, root, own)) if gen else set()
            names = [s.getPath().getName() for s in files.listStatus(_child(spark, root, own))]
            names = sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{BATCH}="))
            counted = [n for n in names if (gen == found.gen if n == MERGED else n not in listed | found.batches)]
            found.folders += [f"{own}/{BATCH}={n}" for n in counted]
            if gen < found.gen:
                found.stale += [f"{own}/{BATCH}={n}" for n in names if n not in counted]
            found.batches |= set(counted) - {MERGED}
            if gen == found.gen:
                found.again = sorted(merged & set(names))
            listed |= merged
        found.batches |= listed
        out.append(found)
    return out


def rewrite_days(
    spark: SparkSession,
    path: str,
    days: Iterable[dt.date],
    change: Callable[[DataFrame], DataFrame],
    rebalance: bool = True,
) -> None:
    """Replace stored days by ``change`` of their events, all in one job.

    Events must stay on their days and keep column ``origin``, the batch they came from. Readers see a
    day's events as they were until its new generation is listed, and then the new ones; a run that was
    cut short leaves nothing that counts.
    """
    clean_days(spark, path)
    wanted = set(days)
    chosen = [d for d in counting_days(spark, path) if d.day in wanted and d.folders]
    if not chosen:
        return
    rows = stored_rows(spark, path, chosen)
    rows = rows.withColumn(ORIGIN, F.coalesce(ORIGIN, BATCH)).drop(GEN, BATCH)
    changed = change(rows)
    ready = changed.select(*complete(changed).columns, ORIGIN, utc_day(F.col("received_at")).alias(DAY))
    ready = ready.withColumn(GEN, _by_day({d.day: d.gen + 1 for d in chosen})).withColumn(BATCH, F.lit(MERGED))
    if rebalance:
        ready = ready.hint("rebalance", DAY)
    _write(ready.sortWithinPartitions(DAY, "event_type", "received_at"), path)
    for d in chosen:
        _list(spark, path, d)


def _list(spark: SparkSession, path: str, day: Day) -> None:
    """Make a day's next generation count, in one step."""
    files, root = _folder(spark, path)
    folder = _child(spark, root, f"{DAY}={day.day}/{GEN}={day.gen + 1}")
    part = _child(spark, folder, f"{LISTED}.{uuid.uuid4().hex}")
    out = files.create(part, True)
    out.write(bytearray("\n".join([*sorted(day.batches), END]).encode()))
    out.close()
    files.rename(part, _child(spark, folder, LISTED))


def compact_day(spark: SparkSession, path: str, day: dt.date, files: int | None = None) -> None:
    """Merge the small files that streams have left in a day into a few.

    Without ``files``, adaptive execution sizes them, so that many tasks write a big day.
    """
    if files is None:
        rewrite_days(spark, path, [day], lambda ev: ev)
    else:
        rewrite_days(spark, path, [day], lambda ev: ev.repartition(files), rebalance=False)


def clean_days(spark: SparkSession, path: str) -> None:
    """Delete what no longer counts: replaced folders, and generations of runs that were cut short.

    The lists of old generations stay: a batch whose writer looked before a rewrite may yet come there.
    """
    files, root = _folder(spark, path)
    if any(len(gens) > 1 for gens in _generations(spark, path).values()) or files.globStatus(
        _child(spark, root, f"{DAY}=*/{GEN}=[1-9]*")
    ):
        for day in counting_days(spark, path):
            for name in day.stale:
                files.delete(_child(spark, root, name), True)


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _child(spark: SparkSession, folder, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)
