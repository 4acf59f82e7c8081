"""N-gram Jaccard join of documents by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, identified, picked, written
from .graph import components
from .hashing import Prefixes, U, mix

CHUNK = 1 << 20
BLOCK = 256


def bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows a band): the most rows, that is the fewest false candidates, with which a pair at the threshold meets in
    some band with probability `recall`, within most_hashes hashes."""
    for rows in range(most_hashes, 0, -1):
        b = ceil(log(1 - recall) / log(1 - threshold**rows))
        if b * rows <= most_hashes:
            return b, rows
    raise ValueError("more hashes are needed for this recall")


def shingles(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text (words joined by single spaces) the sorted hashes of its different n-grams of words. A text of fewer
    words has one, of all its words; an empty one none. Texts are hashed together up to CHUNK bytes."""
    at = 0
    while at < len(texts):
        own, size = [], 0
        while at < len(texts) and (not own or size + len(texts[at]) < CHUNK):
            own.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        buffer = np.frombuffer(b" ".join(own) + b" ", np.uint8)
        ends = np.flatnonzero(buffer == 32)
        starts = np.append(0, ends[:-1] + 1)
        words = Prefixes(buffer).hash(starts, ends)  # an empty text is an empty word
        last = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in own]) - 1) + 1
        for a, b, x in zip(np.append(0, last[:-1]), last, own, strict=True):
            if not x:
                yield np.zeros(0, U)
                continue
            width = min(n, b - a)
            h = words[a : b - width + 1].copy()
            for k in range(1, width):
                h = mix(h) + words[a + k : b - width + 1 + k]
            yield np.unique(mix(h + U(width)))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        state = np.random.default_rng(seed)
        self.a = state.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
        self.b = state.integers(0, 1 << 63, bands * rows, dtype=U)
        self.shape = bands, rows

    def bands(self, x: np.ndarray) -> np.ndarray:
        """A hash of each band's minima."""
        least = np.full(len(self.a), ~U(0))
        for at in range(0, len(x), 1024):
            least = np.minimum(least, (x[at : at + 1024, None] * self.a + self.b).min(0))
        out = np.zeros(self.shape[0], U)
        for column in least.reshape(self.shape).T:
            out = mix(out + column)
        return out


def linked(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: which pairs of sets have a Jaccard similarity of at least threshold. Where `left` is given, only pairs
    of a left set with another one matter, and others are false."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(k), sizes.astype(np.int64))
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what one set has alone is in no intersection
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((k, k), np.float64)
    width = max(1, 4_000_000 // k)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for a, b, base in zip(edges[:-1], edges[1:], range(0, k * len(edges) * width, width), strict=False):
        part = np.zeros((k, width), np.float32)
        part[owner[a:b], column[a:b] - base] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    if left is not None:
        out &= left[:, None] != left
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The first member of each one's connected part."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] < 0:
            root[i] = i
            queue = [i]
            while queue:
                new = np.flatnonzero(link[queue].any(0) & (root < 0))
                root[new] = i
                queue = new.tolist()
    return root


def _normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, most_hashes: int = 96, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and n_links for each row of docs (doc_id, text).

    Two documents are linked if their sets of word n-grams (words between white space, A-Z in lower case) have a Jaccard
    similarity of at least threshold. A class is a connected component of links; its id is its smallest doc_id. n_links
    counts the other rows linked to this one.

    1. Equal texts become one, with a count. MinHash signatures are banded, and rows shuffle on (band, hash). In a bucket
       every text meets the smallest one: as many rows as texts, whatever the bucket's size.
    2. Components of these meetings hold every pair that shares a band. Their members' full n-gram sets are compared, all
       pairs of a component, in tasks of 2 * block texts at most: large components are dealt to pairs of blocks. Tasks give
       a count and one edge for each member, not the pairs.
    3. Components of the verified edges are the classes.

    Pairs at the threshold are found with probability `recall`, more similar ones with more; nothing is linked without its
    sets being compared. Null and empty texts have no n-grams: no links, and each row its own class. Texts of fewer than n
    words have one n-gram. Each row is a document of its own, whether it has no id or shares it with others; n_links counts
    rows, and class_id is null where no row of the class has an id. Empty table: no row. Other columns are ignored.
    """
    found, rows = _classes(docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("row")), threshold, n, recall, most_hashes, block)
    out = rows.select("doc_id", "key").join(found.select(F.col("key").alias("k"), "class_id", "n_links"), F.col("key") == F.col("k"), "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, most_hashes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, class, class_id and n_links of every different text, (doc_id, row, key) of every row of docs (doc_id, text, row));
    keys are digests of texts, null for those without n-grams. row: a hash by which a text is found again."""
    b, r = bands(threshold, recall, most_hashes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", text.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hashes = MinHash(b, r)
        for batch in batches:
            for part in by_size(batch, 2):
                texts = [_normal(c.as_py()) for c in part.column(2)]
                keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in texts]
                first = {}  # of equal texts one is signed
                for i, k in enumerate(keys):
                    first.setdefault(k, i)
                signed: list[list[int] | None] = [None] * len(texts)
                own = [i for k, i in first.items() if k]
                for i, s in zip(own, shingles([texts[i] for i in own], n), strict=True):
                    signed[i] = hashes.bands(s).astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(keys, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "row", "key", "bands"])

    rows = written(base.mapInArrow(sign, "doc_id long, row long, key binary, bands array<long>"))
    # one row stands for all of a text: the first by id, whose text is fetched again to be compared
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("one")
    texts = rows.where("key is not null").groupBy("key").agg(one, F.count(F.lit(1)).alias("copies"), F.max("bands").alias("bands"))
    texts = written(texts.select("key", "one.doc_id", "one.row", "copies", "bands", F.monotonically_increasing_id().alias("rep")))
    dealt = texts.select("rep", F.posexplode("bands").alias("band", "hash"))
    meeting = dealt.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub <> most").drop("most")
    meetings = written(dealt.join(meeting, ["band", "hash"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    groups = written(components(meetings))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "component").join(texts.select("rep", "key", "copies", F.col("doc_id").alias("one"), F.col("row").alias("one_row")), F.col("node") == F.col("rep"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = members.select("rep", "key", "copies", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"), "one", "one_row")
    wanted = base.join(members, (F.col("row") == F.col("one_row")) & F.col("doc_id").eqNullSafe(F.col("one"))).select("rep", "key", "copies", "component", "blocks", "own", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in by_size(batch, 6, most_rows=512):
                texts = [_normal(c.as_py()) for c in part.column(6)]
                right = [hashlib.blake2b(x, digest_size=16).digest() == k for x, k in zip(texts, part.column(1).to_pylist(), strict=True)]
                sets = [s.tobytes() for s in shingles([x for x, y in zip(texts, right, strict=True) if y], n)]
                kept = part.filter(pa.array(right, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:6], pa.array(sets, pa.binary())], names=[*kept.schema.names[:6], "shingles"])

    sets = wanted.mapInArrow(gather, "rep long, key binary, copies long, component long, blocks int, own int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.select("rep", "key", "copies", "component", "own", "shingles", other.alias("other"))
    units = units.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, "component", "x", "y").sortWithinPartitions("component", "x", "y", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        done: list[tuple[int, int, int]] = []
        for batch in batches:
            columns = {c: batch.column(c) for c in ("rep", "key", "copies", "own", "shingles")}
            marks = zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y")), strict=True)
            for i, mark in enumerate(marks):
                if mark != unit:
                    done += _verified(held, unit, threshold)
                    unit, held = mark, []
                row = tuple(columns[c][i].as_py() for c in columns)
                if not held or held[-1][0] != row[0]:  # repeated rows are fetched as often as they come
                    held.append(row)
            yield _edges(done)
            done = []
        yield _edges(_verified(held, unit, threshold))

    found = written(dealt.mapInArrow(verify, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.select("a", "b"))
    reps = texts.select("key", "rep", "doc_id", "copies").join(joined, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    reps = written(reps.select("key", F.coalesce("component", "rep").alias("class"), "doc_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = reps.groupBy(F.col("class").alias("c")).agg(F.min("doc_id").alias("class_id"))
    return reps.join(least, F.col("class") == F.col("c")).select("key", "class", "class_id", "n_links"), rows.select("doc_id", "row", "key")


def _verified(held: list[tuple], unit: tuple | None, threshold: float) -> list[tuple[int, int, int]]:
    """(member, first member of its part, documents linked to it) for members with links."""
    if len(held) < 2:
        return []
    left = np.array([h[3] for h in held]) if unit[1] != unit[2] else None
    link = linked([np.frombuffer(h[4], U) for h in held], threshold, left)
    counts = link @ np.array([h[2] for h in held], np.int64)
    root = _roots(link)
    return [(held[i][0], held[root[i]][0], int(counts[i])) for i in np.flatnonzero(counts)]


def _edges(done: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) if done else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, most_hashes: int = 96, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class, the one with the smallest id (of several, that with the smallest hash); columns stay,
    whatever their names are.

    Rows without an id and repeated rows are copies like others: one of a class stays, one with an id if there is one. Rows
    without n-grams (null and empty texts) all stay. Texts of any length are read whole. Empty table: no row.
    """
    base, at = identified(docs), docs.columns.index("text")
    found, rows = _classes(base.select(F.col("id").alias("doc_id"), F.col(f"c{at}").alias("text"), "row"), threshold, n, recall, most_hashes, block)
    of_class = rows.join(found.select(F.col("key").alias("k"), "class"), F.col("key") == F.col("k"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = of_class.groupBy("class").agg(F.min(place).alias("x")).select("x.row", F.col("x.doc_id").alias("id")).withColumn("copies", F.lit(1))
    # rows without n-grams stay as often as they come
    empty = rows.where("key is null").groupBy("row", F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("copies"))
    times = rows.groupBy(F.col("row").alias("r"), F.col("doc_id").alias("i")).agg(F.count(F.lit(1)).alias("times"))
    same = (F.col("row") == F.col("r")) & F.col("id").eqNullSafe(F.col("i"))
    return picked(docs, written(first.unionByName(empty).join(times, same).select("row", "id", "times", "copies")))
