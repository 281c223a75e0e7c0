"""What the corpus operators share: shipping the package, written intermediate tables, names."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import netlantern
from netlantern.plans.sizing import fresh_path

PACKAGE = os.path.dirname(os.path.abspath(netlantern.__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors, once per application, as ``--py-files`` would.

    Functions of importable modules travel by name, so workers must be able to import them; in
    return, what a worker process has cached serves all its tasks.
    """
    if getattr(spark.sparkContext, "_netlantern_shipped", False):
        return spark
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{fresh_path(spark, 'code')}/netlantern.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    spark.sparkContext._netlantern_shipped = True
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder.

    Work is done once, lineage ends there, and any executor may be lost afterwards.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete written tables that nothing will read again, and let Spark drop shuffles nobody refers to.

    Spark deletes the files of a shuffle once the driver's garbage collection finds it unused, which
    otherwise may be long after.
    """
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Give the system the memory that earlier tasks of this worker freed; a worker runs many, one after another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def new_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever columns it came with."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def row_hash() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("text"))


def rows_kept(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keepers(doc_id, h, copies)``, all columns as they are.

    ``h`` is :func:`row_hash`; ``copies`` says how many rows share both. Of such repeated rows any
    one stays. Rows are spread by both keys, so many rows without a doc_id don't meet.
    """

    def semi(wanted: DataFrame) -> DataFrame:
        named = wanted.select(F.col("doc_id").alias("_keep_id"), F.col("h").alias("_keep_h"))
        for name in named.columns:
            named = named.withColumnRenamed(name, new_name(docs, name))
        a, b = named.columns
        where = docs["doc_id"].eqNullSafe(named[a]) & (F.xxhash64(docs["text"]) == named[b])
        return docs.join(named, where, "left_semi")

    repeated = keepers.filter("copies > 1")
    if repeated.isEmpty():
        return semi(keepers)
    h = new_name(docs, "h")
    once = semi(repeated).withColumn(h, row_hash()).dropDuplicates(["doc_id", h]).drop(h)
    return semi(keepers.filter("copies = 1")).unionByName(once)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled rows of ``docs``, as a written table.

    Rows whose CRC-32 of the doc_id as text leaves 1 when divided by 3 are held out and never come;
    nor do labels that are null, rows without a doc_id, and doc_ids that several rows share. Which rows
    come depends on a hash of the doc_id alone. ``most`` bounds what a model is fitted on.
    """
    single = docs.select("doc_id").dropna().groupBy("doc_id").agg(F.count("*").alias("n"))
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
    known = known.filter("y = other").select("doc_id", "y").filter(~held_out())
    chosen = written(
        single.filter("n = 1").join(known, "doc_id").select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most),
        "labelled",
    )
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), "labelled")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
