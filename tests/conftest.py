import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netlantern.plans.sizing import configure  # noqa: E402
from netlantern.sources.store import complete  # noqa: E402

T0 = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; ``minute`` places them in time, the id is their order."""

    def make(rows):
        names = sorted({k for r in rows for k in r} - {"minute"})
        from netlantern.schema import EVENT_SCHEMA

        fields = ", ".join(
            f"{n} {EVENT_SCHEMA[n].dataType.simpleString()}" for n in names if n != "received_at"
        )
        data = [tuple(r.get(n) for n in names) + (i, r.get("minute", i)) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, (fields + ", " if fields else "") + "_i BIGINT, _m BIGINT")
        base = int(T0.timestamp())
        placed = df.withColumn("received_at", F.timestamp_seconds(F.lit(base) + F.col("_m") * 60))
        if "id" not in names:
            placed = placed.withColumn("id", F.col("_i"))
        if "event_type" not in names:
            placed = placed.withColumn("event_type", F.lit("firewall"))
        return complete(placed)

    return make
