"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, identified, picked, written

WEIGHTS = (1, 2, 3)
CAP = 3


def words(text: Column) -> Column:
    """Number of words; 0 for null. Counts word starts, so that a long text makes no array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(name: Column) -> Column:
    """The source's random offset in [0, 1): the first 13 hex digits of its md5, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), name), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Targets share the sum of all sizes by weight; none is above cap times its source's size, and what is cut off goes to
    the others by weight until none is above. One pass over the sources for each round of cuts; the driver sees sums.
    """
    numbered = ranked(sizes.select(F.lit(0).alias("all"), F.col("source").isNull().alias("last"), "source", "source_size"), "all", ["last", "source"])
    rows = written(numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit, level = F.col("source_size") * cap, 0.0
    while True:
        over = limit < F.col("weight") * F.lit(level)
        r = rows.agg(F.sum(F.when(over, limit)).alias("cut"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = float(total - (r["cut"] or 0)) / float(r["open"])
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(level), limit.cast("double")).alias("target"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `place`: their rank from 0 within the group, without gathering a group in one task.

    Rows are range-partitioned over group and order, so a large group spans many partitions; a partition's first places
    come from prefix sums over the (partition, group) counts, of which there are at most partitions + groups. Names that
    begin with two underscores are its own.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group).isNull(), F.col(group), *map(F.col, order)]

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            own = []
            for x in batch.column(batch.schema.get_field_index(group)).to_pylist():
                at = at + 1 if x == last else 0
                last = x
                own.append(at)
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__own"])

    schema = T.StructType([*rows.schema, T.StructField("__part", T.IntegerType()), T.StructField("__own", T.LongType())])
    local = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    counts = local.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = local.join(first, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return placed.withColumn("place", F.col("__first") + F.col("__own")).drop("__part", "__own", "__p", "__g", "__first")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows (doc_id, source, size, and any others) with source_size, target and copies.

    Each document of a source expects target / source_size copies. The expectations are summed up over the source's
    documents in the order of their sizes, equal ones by a hash of doc_id, from one random offset a source, and a document
    is emitted once for each integer that its sum steps over. In that order the copies are spread evenly over short and
    long documents: a source's words miss its target by at most the size of its longest document. No document has over
    cap copies.

    Null sources are one source, last in order. Documents of size 0 take part, with no words. A source whose size is 0
    has target 0 and copies 0. Null ids are ordered first; repeated rows are documents of their own. Input columns named
    source_size, target or copies are replaced; all other names are safe. Empty table: no row.
    """
    names = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = rows.select(row, F.col("source").cast("string").alias("source"), "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"), "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("tie"))
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = written(targets(sizes, weights, cap).select(F.col("source").alias("s"), "source_size", "target", expected.alias("expected"), offset(F.col("source")).alias("start")))
    at = ranked(rows, "source", ["size", "hash", "doc_id", "tie"])
    steps = F.floor((F.col("place") + 1) * F.col("expected") + F.col("start")) - F.floor(F.col("place") * F.col("expected") + F.col("start"))
    joined = at.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.least(steps.cast("long"), F.lit(cap).cast("long")))
    return joined.select("row.*", "source_size", "target", "copies")


def sample(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs (doc_id, source, text) with each row as often as mix() copies it; columns stay, whatever their names are.

    Texts move once, to meet their counts; the mix itself sees sizes only. Null and empty texts have size 0 and may be
    copied; null ids and sources are as in mix(); repeated rows are copied as often as all of them are. Empty table: no row.
    """
    base = identified(docs)
    at = lambda c: F.col(f"c{docs.columns.index(c)}")
    slim = base.select("row", F.col("id").alias("doc_id"), at("source").alias("source"), words(at(text).cast("string")).alias("size"))
    taken = mix(slim, **options).groupBy("row", F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("times"), F.sum("copies").alias("copies"))
    return picked(docs, written(taken.where("copies > 0")))
