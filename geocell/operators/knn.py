"""k-nearest-neighbour classification and its confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024
#: Training rows that give the first bounds, and how many times more rows each later round has.
FIRST, MORE = 128, 16
#: Vectors of up to so many values are compared in generated code.
UNROLLED = 128
#: Bits a value, rounded for the first test of a pair.
BITS = 6


def _rounded(rows: DataFrame, dims: int) -> tuple[DataFrame, list[Column]]:
    """x rounded to 2 ** BITS levels between its largest absolute value and its negative: a value is near step * (level - middle).

    Columns: p{i}_{w}, bit i of the levels of the w-th 64 values; step; lift, so that the sum of the products of two vectors'
    (level - middle) is that of their levels less both lifts; hat, off and norm, no less than the lengths of the rounded vector, of
    what rounding took away and of the vector. All are found on x over its largest value, where no square over- or underflows. A
    vector with a value that is not finite counts as 0 here."""
    half = 1 << BITS - 1
    middle = half - 0.5
    level = lambda y: F.least(F.floor((y + 1) * half), F.lit(2 * half - 1))
    most = F.array_max(F.transform("x", lambda e: F.abs(e)))
    rows = rows.withColumn("most", F.coalesce(F.when(most < float("inf"), most), F.lit(0.0)))
    rows = rows.withColumn("y", F.transform("x", lambda e: F.when(F.col("most") > 0, e / F.col("most")).otherwise(0.0)))
    rows = rows.withColumn("levels", F.transform("y", level))
    bits = lambda i, w: f"aggregate(slice(levels, {64 * w + 1}, 64), 0L, (s, e) -> shiftleft(s, 1) | (shiftright(e, {i}) & 1L))"
    planes = [F.coalesce(F.expr(bits(i, w)), F.lit(0).cast("long")).alias(f"p{i}_{w}") for i in range(BITS) for w in range(-(-dims // 64))]
    total = lambda each: F.coalesce(F.aggregate("y", F.lit(0.0), lambda s, y: s + each(y)), F.lit(0.0))
    length = lambda each: F.col("most") * F.sqrt(total(lambda y: each(y) * each(y))) * (1 + 1e-9)
    near = lambda y: (level(y) - middle) / half
    norm = length(lambda y: y)
    lift = middle * total(level) - F.size("y") * (middle * middle / 2)
    found = {"step": F.col("most") / half, "lift": lift, "hat": length(near), "off": length(lambda y: y - near(y)) + 1e-9 * norm, "norm": norm}
    return rows, [*planes, *(F.coalesce(c, F.lit(0.0)).alias(name) for name, c in found.items())]


def _product_at_most(dims: int) -> Column:
    """An upper bound of the product of two vectors from their levels: with ^ for a rounded vector, q.t = q^.t^ + q^.(t - t^) +
    (q - q^).t, and the last two are at most the products of the lengths. `off` has a slack of 1e-9 for the rounding of all this."""
    levels = F.lit(0.0)  # counts are added as doubles: adding integers is a call each, for overflow
    for weight in range(2 * BITS - 1):
        met = F.lit(0.0)
        for i in range(max(0, weight - BITS + 1), min(BITS, weight + 1)):
            for w in range(-(-dims // 64)):
                met = met + F.bit_count(F.col(f"q_p{i}_{w}").bitwiseAND(F.col(f"t_p{weight - i}_{w}"))).cast("double")
        levels = levels + met * float(1 << weight)
    c = F.col
    return c("q_step") * c("t_step") * (levels - c("q_lift") - c("t_lift")) + c("q_hat") * c("t_off") + c("q_off") * c("t_norm")


def _prepared(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id, label, deal (a hash), size (-1 for a vector that is null or holds a null), square (its squared length) and
    v, the values in double: a struct of `dims` padded with 0, which generated code reads one by one, and the columns of _rounded,
    or an array if that is too long."""
    x = F.col("embedding")
    whole = F.coalesce(~F.exists(x, lambda e: e.isNull()), F.lit(False))
    rows = rows.select("vec_id", "label", F.xxhash64("vec_id", "label", x).alias("deal"), F.when(whole, F.transform(x, lambda e: e.cast("double"))).alias("x"))
    x = F.coalesce(F.col("x"), F.array().cast("array<double>"))
    rows = rows.select("vec_id", "label", "deal", F.coalesce(F.size("x"), F.lit(-1)).alias("size"), F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e).alias("square"), x.alias("x"))
    v, rounded = F.col("x"), []
    if 0 < dims <= UNROLLED:
        v = F.struct(*[F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)).alias(f"c{i}") for i in range(dims)])
        rows, rounded = _rounded(rows, dims)
    return rows.select("vec_id", "label", "deal", "size", "square", *rounded, v.alias("v"))


def _summed(dims: int, each) -> Column:
    """The sum of each(a, b) over the values of the vectors q_v and t_v."""
    q, t = F.col("q_v"), F.col("t_v")
    if not 0 < dims <= UNROLLED:
        return F.aggregate(F.zip_with(q, t, each), F.lit(0.0), lambda s, d: s + d)
    total = F.lit(0.0)
    for i in range(dims):
        total = total + each(q[f"c{i}"], t[f"c{i}"])
    return total


def _blocks(rows: DataFrame, count: int, name: str, struct: str, prefix: str) -> DataFrame:
    """Rows dealt by hash to `count` arrays of bounded size: name, and the array of them, with a prefix to each column."""
    part = F.pmod("deal", F.lit(count)).cast("int")
    return rows.groupBy(part.alias(name)).agg(F.collect_list(F.struct(*[F.col(c).alias(prefix + c) for c in rows.columns if c != "deal"])).alias(struct))


def _nearest(train: DataFrame, test: DataFrame, dims: int, k: int, blocks: int, sets: int) -> DataFrame:
    """vec_id, label, t_label, unknown, d, t_id and r of the k nearest of every test row. test may have `most`, an upper bound
    of the distance of its k-th: pairs that are surely beyond it are dropped where they are made.

    With squared lengths a pair is beyond `most` if its product is under (q.q + t.t - most * most) / 2; the slack of 1e-12 of
    each term is some hundred times what rounding can do. Lengths that are not finite drop nothing. Up to UNROLLED values the
    product's upper bound from the rounded vectors stands for it: a few words to read instead of all values."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    half = lambda x: F.when((x < float("inf")), x / 2).otherwise(F.lit(float("-inf")))
    slack = 1e-12
    least = half(F.col("square") * (1 - slack))
    bounded = "most" in test.columns
    if bounded:
        own = half(F.col("square") * (1 - slack)) - F.col("most") * F.col("most") * (1 + slack) / 2 - 1e-300
        test = test.withColumn("least", F.coalesce(F.when(F.col("most") * F.col("most") < float("inf"), own), F.lit(float("-inf")))).drop("most")
    left = _blocks(train.withColumn("least", least).drop("square"), blocks, "b", "known", "t_").withColumn("s", every(sets))
    right = _blocks(test.drop("square"), sets, "s", "asked", "q_").withColumn("b", every(blocks))
    # inline and not explode: each column is read once a row into a variable. A loop that reads some 50 columns of structs by
    # name is over what the JVM inlines, and then each read is a call
    asked = left.join(right, ["b", "s"]).select("known", F.inline("asked"))
    pairs = asked.select(*[c for c in asked.columns if c != "known"], F.inline("known"))
    c = F.col
    if bounded:
        product = _product_at_most(dims) if 0 < dims <= UNROLLED else _summed(dims, lambda a, b: a * b)
        pairs = pairs.where(F.coalesce(~(product < c("q_least") + c("t_least")), F.lit(True)))
    # null where the sizes differ or a vector is not whole
    d = F.when((c("q_size") == c("t_size")) & (c("q_size") >= 0), F.lit(0.0)) + F.sqrt(_summed(dims, lambda a, b: (a - b) * (a - b)))
    pairs = pairs.select(c("q_vec_id").alias("vec_id"), c("q_label").alias("label"), c("t_label").alias("t_label"), d.alias("d"), c("t_vec_id").alias("t_id")).withColumn("unknown", F.col("d").isNull())
    # by distance, one that is null last as in SQL, then by id
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("unknown", "d", "t_id"))).where(F.col("r") <= k)


def classify(train: DataFrame, test: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """vec_id, label, predicted: a vote of the k nearest by Euclidean distance; ties go to the nearer, then the smaller label.

    Both sides are dealt to blocks; a pair of blocks is one row's work, of bounded size. Cost is test x train rows as the exact
    search asks, but few pairs become rows: rounds over MORE times more training rows each give every test row a bound, the
    distance of its k-th nearest so far, and the next one drops what lies beyond it. The last round has all training rows, so the
    bounds change the work and not the result. Nothing that is broadcast or gathered grows with the tables."""
    counts = [x.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first() for x in (train, test)]
    n, m = (c[0] for c in counts)
    dims = max(0, *(c[1] or 0 for c in counts))
    conf = train.sparkSession.conf
    if int(conf.get("spark.sql.codegen.maxFields")) < 3 * UNROLLED:  # else rows of two vectors are copied pair by pair
        conf.set("spark.sql.codegen.maxFields", str(3 * UNROLLED))
    train, test = (_prepared(x, dims) for x in (train, test))
    sets, share = max(1, -(-m // block)), 1
    while n > FIRST * share:
        share *= MORE
    asked = test
    while True:
        own = train.where(F.pmod(F.xxhash64("deal"), F.lit(share)) == 0) if share > 1 else train
        near = _nearest(own, asked, dims, k, max(1, -(-n // (block * share))), sets)
        if share == 1:
            break
        share //= MORE
        most = near.where(F.col("r") == k).select(F.col("vec_id").alias("own"), F.col("d").alias("most"))
        asked = test.join(most, F.col("vec_id").eqNullSafe(F.col("own")), "left").drop("own")
    votes = near.groupBy("vec_id", "label", "t_label").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"))
    best = Window.partitionBy("vec_id").orderBy(F.col("n").desc(), "r", "t_label")
    return votes.withColumn("b", F.row_number().over(best)).where("b = 1").select("vec_id", "label", F.col("t_label").alias("predicted"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def scores(predicted: DataFrame) -> DataFrame:
    """One row: errors, accuracy."""
    wrong = F.sum((F.col("label") != F.col("predicted")).cast("long"))
    return predicted.agg(wrong.alias("errors"), (1 - wrong / F.count(F.lit(1))).alias("accuracy"))


def by_label(predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f: precision is null for a label that is never predicted, recall for one that no row has."""
    one, none = F.lit(1), F.lit(0)
    hit = F.coalesce((F.col("label") == F.col("predicted")).cast("int"), none)
    own = F.struct(F.col("label").alias("label"), one.alias("own"), none.alias("called"), hit.alias("hits"))
    called = F.struct(F.col("predicted").alias("label"), none.alias("own"), one.alias("called"), none.alias("hits"))
    sums = predicted.select(F.inline(F.array(own, called))).groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("own", "called", "hits")])
    share = lambda n: F.when(n > 0, F.col("hits") / n)
    return sums.select("label", share(F.col("called")).alias("precision"), share(F.col("own")).alias("recall"), (2 * F.col("hits") / (F.col("own") + F.col("called"))).alias("f"))
