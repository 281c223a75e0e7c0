"""Inputs of the registered queries, derived by Spark from the driver's tables.

The log itself is rendered from ``events``; the lookup tables come from ``nation`` and from the
users seen in ``events``. All of them grow with the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlantern.functions.times import instant, parse_instant
from netlantern.operators.enrich import (
    enrich_events,
    pending_ips,
    resolve_intel,
    upsert_intel,
)
from netlantern.operators import rollup
from netlantern.operators.parse import parse_syslog
from netlantern.plans.barrier import filters_stay_above
from netlantern.plans.sizing import configure, fresh_path
from netlantern.schema import INTEL_SCHEMA
from netlantern.sources.store import append_events, compact_day, read_events, with_raw
from workload import shapes
from workload.shapes import HOT_USER, ext_ip, lan_ip, text

AS_OF = "2024-01-31 00:00:00"
SINCE_30D = "2024-01-01 00:00:00"
SINCE_7D = "2024-01-24 00:00:00"
# Events received before this have been backfilled with intelligence; later ones not yet.
BACKFILLED_UNTIL = "2024-01-25 00:00:00"
# Days before this are summarised before the rest arrives.
SUMMARISED_UNTIL = "2024-01-27 00:00:00"

# Lines that a task renders at most, and that a file of an arrival folder has. Files are in blocks that
# several tasks can read.
ROWS_A_TASK, ROWS_A_FILE, BLOCK = 25_000, 500_000, str(4 << 20)

ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
TWO_LETTERS = (
    f"concat(substr({ALPHABET}, CAST(1 + n_nationkey % 26 AS INT), 1), "
    f"substr({ALPHABET}, CAST(1 + (n_nationkey * 7 + 3) % 26 AS INT), 1))"
)
BLOCK_START = "(11 + CAST(n_nationkey AS BIGINT)) * 16777216"


def ago(days: float) -> str:
    return f"CAST('{AS_OF}' AS TIMESTAMP) - INTERVAL '{int(days * 24)}' HOUR"


# Lookup tables as SQL over ``nation``, ``owners`` (one row per address: ip, u) and ``lans``.
LOOKUPS = {
    "geo_ranges": f"""
        SELECT {BLOCK_START} AS start_ip, {BLOCK_START} + 9000000 AS end_ip,
               {TWO_LETTERS} AS country, concat(n_name, ' East') AS city,
               CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat,
               CAST(n_nationkey * 7 - 80 AS DOUBLE) AS lon
        FROM nation WHERE n_nationkey % 6 <> 5
        UNION ALL
        SELECT {BLOCK_START} + 9000001, {BLOCK_START} + 16777215,
               {TWO_LETTERS}, concat(n_name, ' West'),
               CAST(n_nationkey * 3 - 30 AS DOUBLE), CAST(n_nationkey * 7 - 79 AS DOUBLE)
        FROM nation WHERE n_nationkey % 6 <> 5""",
    "asn_ranges": f"""
        SELECT {BLOCK_START} AS start_ip, {BLOCK_START} + 16777215 AS end_ip,
               concat('AS', {text('64500 + n_nationkey')}, ' ', n_name, ' Net') AS org,
               concat(n_name, ' City') AS city,
               concat('Region ', {text('n_regionkey')}) AS region,
               {TWO_LETTERS} AS country,
               concat('UTC+', {text('n_nationkey % 12')}) AS timezone
        FROM nation WHERE n_nationkey % 4 <> 3""",
    "abuse_feed": f"""
        SELECT ip, CAST(u % 101 AS INT) AS abuse_score, CAST(u % 17 AS INT) AS total_reports,
               'ZZ' AS country_code, concat('isp-', {text('u % 5')}) AS isp,
               'example.net' AS domain, {ago(5)} AS reported_at
        FROM owners WHERE u % 3 = 0 OR u = {HOT_USER}
        UNION ALL
        SELECT ip, CAST(u % 101 + 1 AS INT), CAST(u % 17 AS INT), 'YY', 'old', 'old.net', {ago(30)}
        FROM owners WHERE u % 9 = 0
        UNION ALL
        SELECT ip, 99, 1, 'XX', 'stale', 'stale.net', {ago(100)}
        FROM owners WHERE u % 3 = 1""",
    "ptr_records": f"""
        SELECT ip, 0 AS ord, concat('a-', {text('u')}, '.example.net') AS hostname
        FROM owners WHERE u % 4 = 0
        UNION ALL
        SELECT ip, 1, concat('0-', {text('u')}, '.example.net') FROM owners WHERE u % 4 = 0""",
    "intel_seed": f"""
        SELECT ip, CASE WHEN u % 25 <> 0 THEN 'QS' END AS geo_country,
               CASE WHEN u % 25 <> 0 THEN 'Seedville' END AS geo_city,
               CASE WHEN u % 25 <> 0 THEN CAST(0.0 AS DOUBLE) END AS geo_lat,
               CASE WHEN u % 25 <> 0 THEN CAST(2.5 AS DOUBLE) END AS geo_lon,
               CASE WHEN u % 10 <> 0 THEN CAST((u * 7) % 101 AS INT) END AS abuse_score,
               CASE WHEN u % 20 = 0 THEN concat('seed-', {text('u')}) END AS hostname,
               false AS is_private,
               CASE WHEN u % 15 = 0 THEN {ago(1.25)} ELSE {ago(1 / 24)} END AS updated_at
        FROM owners WHERE u % 5 = 0
        UNION ALL
        SELECT ip, NULL, NULL, NULL, NULL, NULL, NULL, true, {ago(1 / 24)} FROM lans""",
    "targets": f"""
        SELECT {ext_ip('0')} AS target UNION ALL SELECT {ext_ip('25')}
        UNION ALL SELECT {ext_ip(str(HOT_USER))} UNION ALL SELECT {lan_ip('1')}
        UNION ALL SELECT {lan_ip(str(HOT_USER))} UNION ALL SELECT '198.51.100.250'""",
    "intel_updates": f"""
        SELECT ip, 'UP' AS geo_country, 'Updated' AS geo_city, CAST(4.0 AS DOUBLE) AS geo_lat,
               CAST(5.0 AS DOUBLE) AS geo_lon, CAST(u % 50 AS INT) AS abuse_score,
               CAST(NULL AS STRING) AS hostname, false AS is_private,
               CAST('{AS_OF}' AS TIMESTAMP) AS updated_at
        FROM owners WHERE u % 2 = 0""",
}
USERS = f"SELECT DISTINCT {shapes.USER} AS u FROM events"
OWNERS = f"SELECT {ext_ip('u')} AS ip, min(u) AS u FROM users GROUP BY 1"
LANS = f"SELECT DISTINCT {lan_ip('u')} AS ip FROM users WHERE u % 50 = 0"

# (subscriber, wanted types, wanted action); empty means any.
SUBSCRIPTIONS = [
    ("all", [], None),
    ("blocked", [], "block"),
    ("walls", ["firewall", "threat"], None),
    ("walls-blocked", ["firewall", "threat"], "block"),
    ("air", ["wifi"], ""),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str, wanted: Column | None = None) -> DataFrame:
    """What lines are rendered from, of the events ``wanted(id, received_at)``, dealt out to many tasks.

    Events are narrow and their lines are dear, so the blocks of the file would make too few tasks.
    """
    users = table(spark, sf, "events").selectExpr(
        "event_id AS e", f"{shapes.TIME} AS ts", f"{shapes.USER} AS u", f"event_id % {shapes.SHAPE_COUNT} AS k"
    )
    if wanted is not None:
        placed = users.selectExpr("*", "e AS id", "CAST(ts AS TIMESTAMP) AS received_at")
        users = placed.filter(wanted).select(*users.columns)
    tasks = -(-users.count() // ROWS_A_TASK)
    if tasks > 1:
        users = users.repartition(tasks)
    return users.selectExpr("*", *[f"{sql} AS {name}" for name, sql in shapes.PIECES.items()])


def lines(spark: SparkSession, sf: str, wanted: Column | None = None) -> DataFrame:
    """The rendered log: ``id, received_at, raw``; only lines ``wanted(id, received_at)`` are rendered."""
    rendered = base(spark, sf, wanted).selectExpr(
        "e AS id", "CAST(ts AS TIMESTAMP) AS received_at", f"{shapes.RAW} AS raw"
    )
    return filters_stay_above(rendered)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_syslog(lines(spark, sf))


def lookup_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    users = spark.sql(USERS.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))
    owners = spark.sql(OWNERS.replace("FROM users", "FROM {users}"), users=users)
    lans = spark.sql(LANS.replace("FROM users", "FROM {users}"), users=users)
    sql, given = LOOKUPS[name], {}
    for table_name, df in (("nation", table(spark, sf, "nation")), ("owners", owners), ("lans", lans)):
        if f"FROM {table_name}" in sql:
            sql = sql.replace(f"FROM {table_name}", f"FROM {{{table_name}}}")
            given[table_name] = df
    out = spark.sql(sql, **given)
    if name in ("intel_seed", "intel_updates"):
        out = out.select(*[F.col(f.name).cast(f.dataType) for f in INTEL_SCHEMA.fields])
    return out


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SUBSCRIPTIONS, "sub_id STRING, event_types ARRAY<STRING>, action STRING"
    )


_written: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str, write) -> str:
    """Path of a table written once per application into the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = fresh_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def seed_intel(spark: SparkSession, sf: str) -> DataFrame:
    path = written(
        spark, sf, "seed", lambda p: lookup_table(spark, sf, "intel_seed").write.parquet(p)
    )
    return spark.read.schema(INTEL_SCHEMA).parquet(path)


def plain_events(spark: SparkSession, sf: str) -> DataFrame:
    """The stored event table as ingested: parsed, raw text dropped, nothing enriched."""
    path = written(
        spark, sf, "plain",
        lambda p: append_events(with_raw(parsed(spark, sf)), p, bulk=True),
    )
    return read_events(spark, path)


def sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: lookup_table(spark, sf, n) for n in ("geo_ranges", "abuse_feed", "ptr_records")}


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Looked-up rows of all pending addresses."""
    seed = seed_intel(spark, sf)
    pending = pending_ips(plain_events(spark, sf), seed, AS_OF)
    return resolve_intel(pending, seed, AS_OF, **sources(spark, sf))


def intel(spark: SparkSession, sf: str) -> DataFrame:
    """Intelligence after all pending addresses were looked up."""
    path = written(
        spark, sf, "intel",
        lambda p: upsert_intel(seed_intel(spark, sf), resolved(spark, sf)).write.parquet(p),
    )
    return spark.read.schema(INTEL_SCHEMA).parquet(path)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The stored event table, backfilled up to :data:`BACKFILLED_UNTIL`."""

    def write(path: str) -> None:
        stored = plain_events(spark, sf)
        early = F.col("received_at") < instant(BACKFILLED_UNTIL)
        append_events(enrich_events(stored.filter(early), intel(spark, sf)), path, bulk=True)
        append_events(stored.filter(~early), path, bulk=True)

    return read_events(spark, written(spark, sf, "events", write))


def summarised(spark: SparkSession, sf: str) -> str:
    """Path of the same table with summaries of all but its last days, one of them compacted since."""

    def write(path: str) -> None:
        stored = events(spark, sf)
        early = F.col("received_at") < instant(SUMMARISED_UNTIL)
        append_events(stored.filter(early), path, bulk=True)
        rollup.refresh_all(spark, path)
        append_events(stored.filter(~early), path, bulk=True)
        compact_day(spark, path, parse_instant("2024-01-12").date())

    return written(spark, sf, "summarised", write)


def _slices(late: str | None = None) -> list[Column]:
    """Which lines arrive in each slice of time, ``late`` ones in the last."""
    day = F.dayofmonth("received_at")
    own = [(day > start) & (day <= end) for start, end in ((0, 8), (8, 15), (15, 22), (22, 40))]
    if late is None:
        return own
    own = [slice_ & ~F.expr(late) for slice_ in own]
    return [*own[:-1], own[-1] | F.expr(late)]


def _files(rows: int, most: int) -> int:
    """Files of ``most`` rows, and a few of less where there are as many tasks' rows."""
    return max(1, -(-rows // most), min(4, -(-rows // ROWS_A_TASK)))


def _arrive(rendered: DataFrame, files: int, path: str) -> None:
    dealt = rendered.repartition(files)
    dealt.write.option("parquet.block.size", BLOCK).mode("append").parquet(path)


def _sizes(spark: SparkSession, sf: str, slices: list[Column]) -> list[int]:
    events = table(spark, sf, "events")
    placed = events.selectExpr("event_id AS id", f"CAST({shapes.TIME} AS TIMESTAMP) AS received_at")
    return list(placed.agg(*[F.count_if(w).alias(f"n{i}") for i, w in enumerate(slices)]).first())


def arrivals(spark: SparkSession, sf: str) -> str:
    """Folder of the rendered log in several slices of time, as a stream would find it."""

    def write(path: str) -> None:
        slices = _slices()
        for wanted, rows in zip(slices, _sizes(spark, sf, slices)):
            _arrive(lines(spark, sf, wanted), _files(rows, ROWS_A_FILE), path)

    return written(spark, sf, "arrivals", write)


def arrivals_with_late(spark: SparkSession, sf: str, late: str) -> tuple[str, int]:
    """The same with ``late`` rows in the last slice, and how many files each of the slices has."""

    def write(path: str) -> None:
        slices = _slices(late)
        sizes = _sizes(spark, sf, slices)
        # Rows are dealt in turn, so with many more rows than files none is left without rows.
        files = max(1, min(_files(max(sizes), 4 * ROWS_A_TASK), min(sizes) // 1000))
        for wanted in slices:
            _arrive(lines(spark, sf, wanted), files, path)

    path = written(spark, sf, "arrivals-late", write)
    files = len(spark.read.parquet(path).inputFiles())
    if files % len(_slices()):
        raise AssertionError("slices of the log have different numbers of files")
    return path, files // len(_slices())
