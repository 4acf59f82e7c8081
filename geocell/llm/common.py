"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words in every contract of this subpackage.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Spark's setting that removes the shuffle files of a query when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Texts go to Python in small batches, so that a worker's memory stays small beside the executor's."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(mod: int, column: str = "doc_id") -> Column:
    """True where the id's crc32 leaves remainder 2; rows without an id are never held out."""
    return F.coalesce(id_crc(column) % mod == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own (as in
    tests); on a cluster that is an error, as executors would not see each other's files."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='geocell-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, rows: int | None = None, release: bool = False) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: a cut in the lineage that outlives executors.

    The files go when the driver ends. rows: about how many there are, where that is known: small tables get few files.
    release: the shuffle files of the write go with its end; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geocell-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 100_000))
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """docs with its columns as c0, c1, ..., the row's hash `row` and its `id`: rows with the same two are repeated rows. So
    jobs can tell rows apart without writing texts to number them."""
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.xxhash64(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"))


def picked(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that chosen (row, id as identified() has them; times, copies) names, each `copies` times, where
    `times` rows of docs are the same. Columns stay, whatever their names are. Read chosen from a written table."""
    base, names = identified(docs), docs.columns
    wanted = chosen.select(F.col("row").alias("_row"), F.col("id").alias("_id"), "times", "copies")
    same = (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))
    found = base.join(wanted.where("times = 1"), same)
    if wanted.where("times > 1").limit(1).count():
        found = found.unionByName(base.join(wanted.where("times > 1"), same).dropDuplicates(["row", "id"]))
    if wanted.where("copies > 1").limit(1).count():
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def by_size(batch, column: int, most_bytes: int = 4 << 20, most_rows: int = 1024):
    """Slices of an Arrow batch of bounded text size; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and (size + n > most_bytes or k - first >= most_rows):
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass
