"""Language-model scores by context-tree weighting over binary-decomposed byte contexts.

A text is its lower-cased words, joined by single spaces, and an end byte. Each bit of a byte is predicted in every
context of 0 to `depth` bytes (word boundaries are crossed) by the Krichevsky-Trofimov estimate of the training counts;
the estimates are mixed by the context-tree weights: a node's weighted probability is half its own estimate's and half
the product of its children's, computed over the whole training text. A context that training never met gives its weight
to the longest one that it did.

Counts are exact over all documents. The tree is worked out bottom-up and top-down in shards of `split` context bytes, the
few levels above by plain aggregation. Grams move as packed rows, one for each task and bucket of shards; a task holds one
bucket at a time, and the only broadcasts are at most `words` words and `grams` contexts, the most frequent ones; what is
rarer is joined.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, written
from .hashing import mix

END = b"\n"
CHUNK = 1_000_000
HELD = 150_000
U = np.uint64


def _lean() -> None:
    """At the start of a worker's task: what is free goes back to the system, and later on what is free beyond 16 MB at the heap's
    end. Else the C library keeps up to twice the largest array ever freed, and the gaps between arrays, while the worker lives."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, which it would raise by itself
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; the end token is not among them."""
    return (text or "").encode().lower().split()


def _grams(joined: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every position of every text and its end: `depth` bytes of context and the byte itself; and the first
    position of each text."""
    pad = END * depth
    buffer = np.frombuffer(pad + b"".join(x + pad for x in joined), np.uint8)
    keys = np.zeros(len(buffer) - depth, U)
    for j in range(depth + 1):
        keys <<= U(8)
        keys |= buffer[j : len(buffer) - depth + j]
    lengths = np.array([len(x) for x in joined], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]).astype(np.int64)
    if depth > 1:  # of the padding only the end itself counts
        inside = np.zeros(len(keys) + 1, np.int8)
        inside[first] += 1
        inside[first + lengths + 1] -= 1
        keys = keys[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return keys, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)


def _chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size and number, each with the number of its first."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x) + 1
        if size >= CHUNK or k + 1 - at >= most:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _pairs(keys: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of a key and one of 256 owners, sorted, and how often each comes."""
    if depth < 7:  # one number holds both
        both = (keys << U(8)) | owner.astype(U)
        both.sort()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return both[first] >> U(8), (both[first] & U(255)).astype(np.int64), np.diff(np.append(first, len(both)))
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
    return keys[first], owner[first], np.diff(np.append(first, len(keys)))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _prepared(docs: DataFrame, held: Column) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))


def count_words(docs: DataFrame, held: Column) -> DataFrame:
    """word and n: its training count (0 for words that only held-out texts have). The end token is b"\\n"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for cell, out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[out].update(tokens(cell.as_py()))
                seen[out][END] += 1
                if len(seen[0]) + len(seen[1]) > HELD:  # partial sums are summed after the shuffle
                    yield words_of(*seen)
                    seen = [Counter(), Counter()]
        yield words_of(*seen)

    def words_of(train: Counter, rest: Counter) -> pa.RecordBatch:
        new = [w for w in rest if w not in train]
        return pa.RecordBatch.from_arrays([pa.array([*train, *new], pa.binary()), pa.array([*train.values(), *[0] * len(new)], pa.int64())], names=["word", "n"])

    return _prepared(docs, held).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shard(keys: np.ndarray, split: int) -> np.ndarray:
    return (keys >> U(8)) & U((1 << (8 * split)) - 1)


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted grams and their counts: bytes of equal weight lie together, which compresses well in the shuffle."""
    return b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(keys, prepend=U(0)), n.astype(U)))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(2, 8, -1)
    steps, n = (np.ascontiguousarray(p.T).view(U)[:, 0] for p in planes)
    return np.cumsum(steps, dtype=U), n.astype(np.int64)


def count_grams(docs: DataFrame, held: Column, depth: int, split: int, buckets: int) -> DataFrame:
    """bucket and data: packed grams with their training counts (0 for those that only held-out texts have), by bucket of
    shards; partial sums, to be summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for part in by_size(batch, 0):
                flags = part.column(1).to_pylist()
                for wanted in (False, True):
                    texts = [b" ".join(tokens(c.as_py())) for c, out in zip(part.column(0), flags, strict=True) if out is wanted]
                    for _, some in _chunks(texts):
                        own = _grams(some, depth)[0]
                        own.sort()
                        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        keys.append(own[first])
                        counts.append(np.zeros(len(first), np.int64) if wanted else np.diff(np.append(first, len(own))))
                if sum(map(len, keys)) > 8 * HELD:
                    k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [n]
                    if len(k) > 5 * HELD:
                        yield dealt(k, n)
                        keys, counts = [], []
        if keys:
            yield dealt(*_summed(np.concatenate(keys), np.concatenate(counts)))

    def dealt(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(_shard(keys, split)) % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # within a bucket by gram
        bucket, keys, n = bucket[order], keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        rows = [_packed(keys[a:b], n[a:b]) for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "data"])

    return _prepared(docs, held).mapInArrow(run, "bucket int, data binary")


# ---- the tree ------------------------------------------------------------------------------------------------------


def _log_gamma(x):
    """By Stirling's series after seven steps up; to 1e-12 for x of at least a half. For arrays and for columns."""
    log = F.log if isinstance(x, Column) else np.log
    y = x + 7.0
    p = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0)
    r = 1.0 / y
    return (y - 0.5) * log(y) - y + 0.9189385332046727 + r / 12.0 - r * r * r / 360.0 + r * r * r * r * r / 1260.0 - log(p)


def kt(n0, n1):
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts; 0 without any."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


class _Shard:
    """The tree's levels from `depth` up to `split` for grams whose last `split` context bytes are here as a whole."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, split: int):
        self.grams, n = _summed(grams.astype(U), n.astype(np.float64))
        context, byte = self.grams >> U(8), (self.grams & U(255)).astype(np.int64)
        nodes = np.concatenate([(context << U(8)) | ((1 << k) | (byte >> (8 - k))).astype(U) for k in range(8)])
        self.bits = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
        keys, self.at = np.unique(nodes, return_inverse=True)
        both = np.bincount(self.at, np.tile(n, 8), len(keys))
        n1 = np.bincount(self.at, np.tile(n, 8) * self.bits, len(keys))
        n0, below = both - n1, None
        self.levels = []  # from the deepest: keys, n0, n1, stopping weight, place of the parent
        for d in range(depth, split - 1, -1):
            own = kt(n0, n1) * (n0 + n1 > 0)
            if below is None:
                weighted, stop = own, np.ones(len(own))
            else:
                weighted = np.logaddexp(own, below) - np.log(2.0)
                stop = np.exp(own - np.log(2.0) - weighted)
            if d == split:
                self.levels.append((keys, n0, n1, stop, None))
                self.top = keys, n0, n1, weighted
                break
            mask = (1 << (8 * (d - 1))) - 1
            up, place = np.unique((((keys >> U(8)) & U(mask)) << U(8)) | (keys & U(255)), return_inverse=True)
            self.levels.append((keys, n0, n1, stop, place))
            n0, n1, below = (np.bincount(place, x, len(up)) for x in (n0, n1, weighted))
            keys = up

    def log10(self, keys: np.ndarray, mixed: np.ndarray, left: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """For each gram the log10 probability of its byte; given for the nodes of the top level what the levels above
        have mixed for a 0, the weight left, and the answer if it ended there."""
        at = np.searchsorted(keys, self.levels[-1][0])
        mixed, left, settled = mixed[at], left[at], settled[at]
        for k in range(len(self.levels) - 1, -1, -1):
            _, n0, n1, stop, _ = self.levels[k]
            p, seen = (n0 + 0.5) / (n0 + n1 + 1.0), n0 + n1 > 0
            settled = np.where(seen, mixed + left * p, settled)
            mixed = np.where(seen, mixed + left * stop * p, mixed)
            left = np.where(seen, left * (1 - stop), left)
            if k:
                place = self.levels[k - 1][4]
                mixed, left, settled = mixed[place], left[place], settled[place]
        zero = settled[self.at]
        return np.log10(np.where(self.bits == 0, zero, 1 - zero)).reshape(8, -1).sum(0)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket, as a table for each bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        marks = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1), len(marks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("bucket")[0].as_py() != marks[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _runs(keys: np.ndarray, n: np.ndarray, split: int, most: int = HELD // 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in runs of whole shards: more than about `most` only where one shard has them."""
    shard = _shard(keys, split)
    order = np.argsort(shard, kind="stable")
    keys, n, shard = keys[order], n[order], shard[order]
    at = 0
    while at < len(keys):
        end = at + most
        end = len(keys) if end >= len(keys) else int(np.searchsorted(shard, shard[end - 1], "right"))
        yield keys[at:end], n[at:end]
        at = end


def _grams_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The summed grams of a bucket's packed rows."""
    parts = [_unpacked(x.as_py()) for x in t.column("data") if x.is_valid]
    return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, U), np.zeros(0, np.int64))


def weigh(grams: DataFrame, depth: int, split: int) -> DataFrame:
    """gram, n and logp (log10 of the byte's probability in its context), from count_grams().

    A shard holds different grams of one `split`-byte context, at most 256 ** (depth - split + 1) however often they occur.
    Tasks sort by bucket, hold a bucket's packed grams at a time and work them out in runs of whole shards.
    """
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        for t in _buckets(batches):
            bucket = t["bucket"][0].as_py()
            keys, n = _grams_of(t)
            for some, count in _runs(keys, n, split):
                top, n0, n1, weighted = _Shard(some, count, depth, split).top
                k = len(top)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, bucket, np.int32)), pa.nulls(k, pa.binary()), pa.array((top >> U(8)).astype(np.int64)), pa.array((top & U(255)).astype(np.int32)), pa.array(n0), pa.array(n1), pa.array(weighted)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_packed(keys, n)], pa.binary()), *[pa.nulls(1, k) for k in (pa.int64(), pa.int32(), *[pa.float64()] * 3)]], names=names)

    schema = "bucket int, data binary, context long, node int, n0 double, n1 double, weighted double"
    names = [x.split()[0] for x in schema.split(", ")]
    worked = written(grams.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(up, schema), release=True)
    level = worked.where("data is null")
    below, levels = level, []
    for d in range(split - 1, -1, -1):
        own = F.when(F.col("n0") + F.col("n1") > 0, kt(F.col("n0"), F.col("n1"))).otherwise(0.0)
        a, b = F.col("own"), F.col("below")
        most = F.greatest(a, b)
        summed = below.groupBy(F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")).withColumn("own", own)
        below = summed.withColumn("weighted", most + F.log(F.exp(a - most) + F.exp(b - most)) - F.log(F.lit(2.0)))
        below = written(below.withColumn("stop", F.exp(a - F.log(F.lit(2.0)) - F.col("weighted"))).drop("own", "below"), release=True)
        levels.append(below)
    p, seen = (F.col("n0") + 0.5) / (F.col("n0") + F.col("n1") + 1.0), F.col("n0") + F.col("n1") > 0
    prior = None
    for d, own in enumerate(reversed(levels)):
        if prior is None:
            own = own.withColumns({"mixed": F.lit(0.0), "left": F.lit(1.0), "settled": F.lit(0.5)})
        else:
            own = own.withColumn("up", F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))).join(prior, ["up", "node"])
        prior = own.select(
            F.col("context").alias("up"), "node",
            F.when(seen, F.col("mixed") + F.col("left") * F.col("stop") * p).otherwise(F.col("mixed")).alias("mixed"),
            F.when(seen, F.col("left") * (1 - F.col("stop"))).otherwise(F.col("left")).alias("left"),
            F.when(seen, F.col("mixed") + F.col("left") * p).otherwise(F.col("settled")).alias("settled"),
        )
    top = level.withColumn("up", F.col("context").bitwiseAND(F.lit((1 << (8 * (split - 1))) - 1))).join(prior, ["up", "node"])
    top = top.select("bucket", F.lit(None).cast("binary").alias("data"), (F.shiftleft("context", 8) + F.col("node")).alias("gram"), "mixed", "left", "settled")
    rows = worked.where("data is not null").select("bucket", "data").unionByName(top, allowMissingColumns=True)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        for t in _buckets(batches):
            keys, n = _grams_of(t)
            given = t.filter(pc.is_null(t["data"]))
            nodes = given["gram"].to_numpy().astype(U)
            order = np.argsort(nodes)
            nodes = nodes[order]
            above = [given[c].to_numpy()[order] for c in ("mixed", "left", "settled")]
            for some, count in _runs(keys, n, split):
                s = _Shard(some, count, depth, split)
                logp = s.log10(nodes, *above)
                yield pa.RecordBatch.from_arrays([pa.array(s.grams.astype(np.int64)), pa.array(_summed(some, count)[1]), pa.array(logp.astype(np.float32))], names=["gram", "n", "logp"])

    return written(rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(down, "gram long, n long, logp float"), release=True)


# ---- scoring -------------------------------------------------------------------------------------------------------


class Table:
    """An open-addressing table of grams in two arrays."""

    EMPTY = U(0xFFFFFFFFFFFFFFFF)

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(grams) / 0.7).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, U)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(grams)), self.slot(grams.astype(U))
        grams = grams.astype(U)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = grams[left[free]]  # of several the last one stays
            placed = self.keys[slot] == grams[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and places of the keys that are not here (their values are 0)."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.float32(0))
        missing = []
        left = np.flatnonzero(held != keys)
        while len(left):
            gone = held[left] == self.EMPTY
            missing.append(left[gone])
            left = left[~gone]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held[left] = self.keys[slot[left]]
            good = held[left] == keys[left]
            out[left[good]] = self.values[slot[left[good]]]
            left = left[~good]
        return out, np.concatenate(missing) if missing else np.zeros(0, np.int64)


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count n such that at most `most` rows have n or more; at least 1."""
    histogram = counts.where("n > 0").groupBy("n").count().toArrow()
    sizes = sorted(zip(histogram["n"].to_pylist(), histogram["count"].to_pylist(), strict=True), reverse=True)
    least = sizes[0][0] + 1 if sizes else 1
    for n, count in sizes:
        if count > most:
            break
        least, most = n, most - count
    return least


def score(docs: DataFrame, held: Column, depth: int = 6, split: int = 3, words: int = 150_000, grams: int = 2_900_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_coded and bits_per_byte for every row of docs
    (doc_id, text). score is the log10 probability of the text, n_coded the bytes it is coded as, with the end, and
    bits_per_byte the code length of these.

    words: at most so many of the most frequent words go to all workers; the rest are joined by key. grams: the same for
    byte contexts. Both bound broadcasts only; results do not depend on them but for the order of sums.

    Null text is empty: its end token is all it has. Rows where `held` is null are training rows. Null ids stay null;
    repeated rows count and come as often as they are. Long texts are read whole. With no training row every word is
    unknown and each bit costs one bit. An empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = written(count_words(docs, held), release=True)
    total, different = vocabulary.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total = total or 0
    if not 0 <= split <= depth <= 7:
        raise ValueError("contexts have at most 7 bytes, and split is one of their lengths")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighed = weigh(count_grams(docs, held, depth, split, buckets), depth, split)
    room = total + 1 * (different + 1)
    top = vocabulary.where(F.col("n") >= _least(vocabulary, words)).toArrow()
    common = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    least = _least(weighed, grams)
    near = weighed.where(F.col("n") >= least).select("gram", "logp").toArrow()
    shared = spark.sparkContext.broadcast((common, Table(near["gram"].to_numpy(), near["logp"].to_numpy())))
    del near, top

    def far_rows(owner: np.ndarray, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        """A row for each text and gram that is to be joined."""
        k = len(keys)
        wide = np.full((k, 9), 32, np.uint8)
        wide[:, 1:] = keys.astype(">u8").view(np.uint8).reshape(k, 8)
        key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), k, [None, pa.py_buffer(wide.tobytes())]).cast(pa.binary())
        zeros, nothing = pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k))
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), zeros, zeros, nothing, nothing, zeros, key, pa.array(times)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        known, table = shared.value
        logs = {n: float(np.log10((n + 1) / room)) for n in set(known.values())}  # equal counts share a number
        base = {w: logs[n] for w, n in known.items()}
        for batch in batches:
            for part in by_size(batch, 2):
                ids = part.column(0).to_pylist()
                split_texts = [tokens(c.as_py()) for c in part.column(2)]
                scores = np.zeros(len(ids))
                rows: list[tuple] = []
                for first, texts in _chunks([b" ".join(x) for x in split_texts], 256):
                    keys, starts = _grams(texts, depth)
                    keys, owner, times = _pairs(keys, np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(keys)))), depth)
                    new = np.concatenate([[True], keys[1:] != keys[:-1]])
                    values, missing = table.find(keys[new])
                    far = np.zeros(len(values), bool)
                    far[missing] = True
                    which = np.cumsum(new) - 1
                    scores[first : first + len(texts)] = np.bincount(owner, values.astype(np.float64)[which] * times, len(texts))
                    if len(missing):
                        far = far[which]
                        yield far_rows(np.array(ids[first : first + len(texts)], np.int64)[owner[far]], keys[far], times[far])
                main = []
                for rid, own in zip(ids, split_texts, strict=True):
                    coded = sum(map(len, own)) + max(1, len(own))
                    own.append(END)
                    found = list(map(base.get, own))
                    if None in found:
                        rows += [(rid, w, n) for w, n in Counter(w for w, x in zip(own, found, strict=True) if x is None).items()]
                        found = [x for x in found if x is not None]
                    main.append((len(found), sum(found), len(own), coded))
                k = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids + [r[0] for r in rows], pa.int64()),
                    pa.concat_arrays([part.column(1), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([part.column(3), pa.nulls(k, pa.bool_())]),
                    pa.array([m[2] for m in main] + [0] * k, pa.int64()), pa.array([m[0] for m in main] + [0] * k, pa.int64()),
                    pa.array([m[1] for m in main] + [0.0] * k, pa.float64()), pa.array(scores.tolist() + [0.0] * k, pa.float64()),
                    pa.array([m[3] for m in main] + [0] * k, pa.int64()),
                    pa.array([b" m" + int(i).to_bytes(8, "big") for i in ids] + [r[1] for r in rows], pa.binary()),
                    pa.array([0] * len(ids) + [r[2] for r in rows], pa.int64()),
                ], names=names)

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_coded long, key binary, times long"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held")).mapInArrow(run, schema)
    rest = vocabulary.select(F.col("word").alias("k"), F.log10((F.col("n") + 1) / F.lit(float(room))).alias("kb"), (F.col("n") > 0).cast("long").alias("kk"), F.lit(0.0).alias("ks"))
    far = weighed.where(F.col("n") < least).select(F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex("gram"), 16, "0"))).alias("k"), F.lit(0.0).alias("kb"), F.lit(0).cast("long").alias("kk"), F.col("logp").cast("double").alias("ks"))
    joined = rows.join(rest.unionByName(far), F.col("key") == F.col("k"), "left")
    part = lambda c: F.coalesce(F.col("times") * F.col(c), F.lit(0))
    sums = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + part("kk"), "base_score": F.col("base") + part("kb"), "score": F.col("score") + part("ks"), "n_coded": F.col("n_coded")}
    out = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(name) for name, c in sums.items()])
    bits = -F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_coded")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_coded", bits.alias("bits_per_byte"))
