"""Document quality: a classifier's evidence combined with hierarchical empirical Bayes site posteriors."""

from __future__ import annotations


from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, written

FEATURES = ("log_words", "upper", "symbols", "bangs", "bars", "digits", "adjacent", "top_word", "repeats", "lines", "word_length", "short")
_UPPER, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~[]"
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Figures about the form of a whole text; all 0 (but `short`) for a null or empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size = len(raw)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    letters = max(share(_LETTERS), 1 / size)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    return [np.log1p(n), share(_UPPER) / letters, share(_SYMBOLS) * 10, share(b"!") * 10, share(b"|") * 10, share(_DIGITS) * 10, adjacent / n, max(counts.values()) / n if n >= 20 else 0.0, 1 - (pairs + 1) / n, 1 - len(set(lines)) / len(lines), min(size / n, 40) / 10, float(n < 20)]


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = 20_000, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept last) of a logistic regression, by Newton's steps on a bounded sample of labelled rows.

    The sample: the sample_rows rows with the smallest hash of their features, which is all that leaves the executors. With
    one class only, the weights are 0 but for the intercept; with no rows all are 0.
    """
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("double").alias("y")).where("y is not null")
    got = scored_features(rows, "t", ["y"]).orderBy(F.xxhash64("features"), "y").limit(sample_rows).collect()
    weights = np.zeros(len(FEATURES) + 1)
    if not got:
        return weights
    x = np.array([[*r["features"], 1.0] for r in got])
    y = np.array([r["y"] for r in got])
    if y.min() == y.max():
        weights[-1] = 4.0 if y[0] > 0.5 else -4.0
        return weights
    penalty = np.diag([ridge] * len(FEATURES) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ weights)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def scored_features(rows: DataFrame, text: str, keep: list[str], weights: np.ndarray | None = None) -> DataFrame:
    """The columns of keep with `features`, or with `evidence` (the classifier's log-odds) if weights are given.

    A string text that is itself in keep goes to Python once. Texts are worked on in slices of bounded size.
    """
    name = "features" if weights is None else "evidence"
    carried = text in keep and isinstance(rows.schema[text].dataType, T.StringType)
    place, first = (keep.index(text), 0) if carried else (0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, place, most_rows=512):
                x = [features(c.as_py()) for c in part.column(place)]
                if weights is None:
                    out = pa.array(x, pa.list_(pa.float64()))
                else:
                    out = pa.array(np.clip(np.array(x) @ weights[:-1] + weights[-1], -30, 30), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[first:], out], names=[*keep, name])

    picked = rows.select(*([] if carried else [F.col(text).cast("string").alias("_text")]), *keep)
    kind = T.ArrayType(T.DoubleType()) if weights is None else T.DoubleType()
    return picked.mapInArrow(run, T.StructType([*picked.schema[first:], T.StructField(name, kind)]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str = "mean", n: str = "n", prior: str = "prior", least: float = 2.0, most: float = 1000.0) -> float:
    """Prior strength (in documents) of a level by the method of moments: how far its groups' means spread beyond what
    their sizes explain. One row of sums comes to the driver."""
    p = F.col(prior)
    r = groups.where(F.col(n) >= 2).agg(F.sum(F.col(n) * (F.col(mean) - p) ** 2).alias("spread"), F.sum(p * (1 - p)).alias("chance"), F.sum((F.col(n) - 1) * p * (1 - p)).alias("room")).first()
    if not r["room"]:
        return most
    between = max((r["spread"] - r["chance"]) / r["room"], 0.0)  # variance of the true rates over p (1 - p)
    return float(min(max(1 / between - 1, least), most)) if between > 0 else most


def sites(evidence: DataFrame) -> DataFrame:
    """host, path and what their posteriors are made of, from evidence (host, path, good); good is the classifier's
    probability, or any other from 0 to 1: n and s (rows and their good ones), hn and hs (the host's), rate, k and k2 (the
    strengths of the global rate and of the host), host_posterior and posterior.

    Good counts are summed by (host, path) with partial sums before the shuffle, hosts from these. A host's posterior
    shrinks to the global rate, a path's to its host's posterior, each by its level's own strength: sites with few
    documents say little. Null hosts and paths are groups of their own. No evidence: no row.
    """
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    rate = float((total[1] + 1) / (total[0] + 2)) if total[0] else 0.5
    k = _strength(hosts.select((F.col("hs") / F.col("hn")).alias("mean"), F.col("hn").alias("n"), F.lit(rate).alias("prior")))
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + k * rate) / (F.col("hn") + k)).withColumnRenamed("host", "h")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k2 = _strength(paths.select((F.col("s") / F.col("n")).alias("mean"), "n", F.col("host_posterior").alias("prior")))
    return paths.withColumns({"posterior": (F.col("s") + k2 * F.col("host_posterior")) / (F.col("n") + k2), "rate": F.lit(rate), "k": F.lit(k), "k2": F.lit(k2)})


def combine(rows: DataFrame, posteriors: DataFrame, site_weight: float = 0.5) -> DataFrame:
    """rows (host, path, evidence, good, ...) with site_posterior and score: evidence and the site's log-odds against the
    global rate, as a probability.

    site_posterior is what the site's other rows say: a row's own `good` is taken out of its path and host first, so that
    its evidence does not count twice. Skew of hosts is on the left side only; adaptive execution splits it.
    Rows whose site is not among the posteriors keep their evidence. Names that begin with two underscores are its own.
    """
    s = posteriors.select(*[F.col(c).alias(f"__{c}") for c in ("host", "path", "n", "s", "hn", "hs", "rate", "k", "k2")])
    joined = rows.join(s, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    of = lambda c: F.col(f"__{c}")
    host = (of("hs") - F.col("good") + of("k") * of("rate")) / (of("hn") - 1 + of("k"))
    joined = joined.withColumn("__prior", host).withColumn("site_posterior", (of("s") - F.col("good") + of("k2") * of("prior")) / (of("n") - 1 + of("k2")))
    shift = F.coalesce(_logit(F.col("site_posterior")) - _logit(of("rate")), F.lit(0.0))
    return joined.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + site_weight * shift)))).drop(*s.columns, "__prior")


def marks(labels: DataFrame) -> DataFrame:
    """mark_id and quality: one label a document, the smallest of several. Labels without an id or a value are left out."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("mark_id")).agg(F.min("quality").cast("double").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> np.ndarray:
    """The classifier's weights from docs (doc_id, text) and labels (doc_id, quality): see marks() and fit().

    Of the documents that have labels, the texts of sample_rows (those with the smallest hash of their id) are read.
    """
    found = docs.select(F.col("doc_id").alias("id")).join(marks(labels), F.col("id") == F.col("mark_id"), "left_semi").distinct()
    picked = found.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample_rows)
    picked = picked.join(marks(labels), F.col("id") == F.col("mark_id")).select("id", "quality")
    # sample_rows rows at most are broadcast; only the sample's texts leave the scan
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    return fit(rows.select("text", "quality"), sample_rows=sample_rows)


def _scored(docs: DataFrame, host: Column, path: Column, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """The columns as c0, c1, ..., with host, path, evidence and good (the classifier's probability)."""
    rows = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], host.cast("string").alias("host"), path.cast("string").alias("path"))
    text = f"c{columns.index('text')}" if "text" in columns else "text"
    scored = scored_features(rows, text, [c for c in rows.columns if c != "text"], weights)
    return scored.withColumn("good", 1 / (1 + F.exp(-F.col("evidence"))))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, evidence, site_posterior, score and kept (score of at least threshold), a row for each of docs.

    Labels train the classifier and nothing else: no document's own label is in its score but by the weights.

    Null or empty texts have the features of an empty text. Null hosts, paths and ids are values of their own. Repeated
    rows repeat and count as often in their site. Without labels nothing is known: evidence 0, score 0.5, all kept. Texts of
    any length are read whole. An empty table gives no row. Other columns are ignored.
    """
    weights = train(docs, labels, sample_rows)
    slim = written(_scored(docs, host, path, weights, ["doc_id"]))
    scored = combine(slim, written(sites(slim)))
    return scored.select(F.col("c0").alias("doc_id"), "evidence", "site_posterior", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """docs without the rows that classify() rejects; their columns stay, whatever their names are.

    Texts are scored twice, for their sites and for themselves, so that they are neither written nor moved in between. Null
    and empty texts, nulls elsewhere, repeated rows and missing labels are as in classify(). An empty table gives no row.
    """
    weights = train(docs, labels, sample_rows)
    names = docs.columns
    posteriors = written(sites(written(_scored(docs, host, path, weights, ["doc_id"]))))
    scored = combine(_scored(docs, host, path, weights, names), posteriors)
    return scored.where(F.col("score") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
