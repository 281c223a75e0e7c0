"""Partial aggregates of the stored event table, kept folder by folder.

A summary mirrors the event table: each folder that counts has a folder of the same name beside the table
with the partial aggregate of its rows, and a mark of the files it was made from. A folder that came later,
was written again or merged has no summary of that mark, and then its rows themselves are read and
aggregated. So answers are those of the whole table however far :func:`refresh` has come; writers needn't
know that summaries exist.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.functions.times import instant, parse_instant
from netlantern.sources import store
from netlantern.sources.store import BATCH, DAY, FOLDER_SCHEMA, GEN, MERGED, Day

FOLDER, MARK = [DAY, GEN, BATCH], "mark"


@dataclass(frozen=True)
class Kind:
    """A partial aggregate: ``build(rows, folder)`` groups by the ``folder`` columns and its own keys.

    ``parts`` are columns by which a folder's summary is cut into folders of its own.
    """

    name: str
    build: Callable[[DataFrame, list[str]], DataFrame]
    parts: tuple[str, ...] = ()

    def schema(self, spark: SparkSession) -> T.StructType:
        return self.build(spark.createDataFrame([], FOLDER_SCHEMA), FOLDER).schema


def summary_path(path: str, kind: Kind) -> str:
    return f"{path.rstrip('/')}-{kind.name}"


def _marks(spark: SparkSession, path: str, days: Iterable[Day]) -> dict[str, str]:
    """The folders that count, and a mark of what is in each."""
    files, root = store._folder(spark, path)
    marks = {}
    for d in days:
        for folder in d.folders:
            names = [s.getPath().getName() for s in files.listStatus(store._child(spark, root, folder))]
            if folder.endswith(f"{BATCH}={MERGED}"):
                names += [f"{BATCH}={b}" for b in d.again]
            marks[folder] = hashlib.sha1("\n".join(sorted(names)).encode()).hexdigest()[:16]
    return marks


def _kept(spark: SparkSession, path: str, kind: Kind) -> set[str]:
    """Folders of the summary, with their marks."""
    files, root = store._folder(spark, summary_path(path, kind))
    found = files.globStatus(store._child(spark, root, f"{DAY}=*/{GEN}=*/{BATCH}=*/{MARK}=*")) or []
    return {"/".join(s.getPath().toString().split("/")[-4:]) for s in found}


def _only(days: Iterable[Day], folders: set[str]) -> list[Day]:
    return [replace(d, folders=[f for f in d.folders if f in folders]) for d in days]


def refresh(spark: SparkSession, path: str, kind: Kind) -> int:
    """Summarise the folders that have no summary yet, in one job; returns how many.

    Summaries of folders that no longer count are deleted.
    """
    days = store.counting_days(spark, path)
    marks = _marks(spark, path, days)
    kept = _kept(spark, path, kind)
    wanted = {f"{folder}/{MARK}={mark}": folder for folder, mark in marks.items()}
    missing = {folder for name, folder in wanted.items() if name not in kept}
    if missing:
        named = [(*_values(f), marks[f]) for f in sorted(missing)]
        table = spark.createDataFrame(named, f"{DAY} date, {GEN} int, {BATCH} string, {MARK} string")
        rows = kind.build(store.stored_rows(spark, path, _only(days, missing)), FOLDER)
        places = [*FOLDER, MARK, *kind.parts]
        # Else every task of the aggregate would write a file into every folder.
        ready = rows.join(F.broadcast(table), FOLDER).hint("rebalance", *places)
        ready.write.partitionBy(*places).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(
            summary_path(path, kind)
        )
    files, root = store._folder(spark, summary_path(path, kind))
    for name in kept - set(wanted):
        files.delete(store._child(spark, root, name), True)
    return len(missing)


def _values(folder: str) -> tuple[dt.date, int, str]:
    day, gen, batch = (part.split("=", 1)[1] for part in folder.split("/"))
    return dt.date.fromisoformat(day), int(gen), batch


def partials(
    spark: SparkSession, path: str, kind: Kind, since: dt.datetime | str | None = None
) -> DataFrame:
    """Partial rows of all events received since a time: from summaries where there are any.

    Rows themselves are read of folders without a summary, and of the day in which the period begins.
    """
    days = store.counting_days(spark, path)
    first = []
    if since is not None:
        start = parse_instant(since)
        first = [d for d in days if d.day == start.date() and start.time() != dt.time()]
        days = [d for d in days if d.day >= start.date() and d not in first]
    marks, kept = _marks(spark, path, days), _kept(spark, path, kind)
    have = {f: f"{f}/{MARK}={m}" for f, m in marks.items() if f"{f}/{MARK}={m}" in kept}
    schema = kind.schema(spark)
    parts = []
    if have:
        base = summary_path(path, kind)
        names = [f"{base}/{name}" for name in have.values()]
        read = spark.read.schema(schema).option("basePath", base).parquet(*names)
        parts.append(read.select(*schema.names))
    rest = [*_only(days, set(marks) - set(have)), *first]
    if any(d.folders for d in rest):
        rows = store.stored_rows(spark, path, rest)
        if since is not None:
            rows = rows.filter(F.col("received_at") >= instant(since))
        parts.append(kind.build(rows, FOLDER).select(*schema.names))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
