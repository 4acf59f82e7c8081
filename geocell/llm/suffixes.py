"""Removal of long repeated byte strings by a pruned suffix array.

A full suffix array sorts every suffix of the corpus. Nearly all of them begin with no repeated string, so they are pruned
first, without loss; the array is built of the rest. Every window of `length` bytes is assigned to an anchor in it: the place
of its smallest hash of a `gram`-byte string. Equal windows have equal anchors at equal places. So

1. Anchors: runs of windows with one anchor are the unit. Where an anchor's gram occurs once, none of its windows can
   repeat. Equal runs (same gram, same bytes by a 112-bit hash) repeat as a whole: all but the first are removed at once.
2. Windows: what is left are first runs of grams that also occur in other runs, where repeats begin and end. Of their windows
   only those whose 48-bit hash comes again stay.
3. Suffixes: the windows that stay are sorted as suffixes by their bytes. Sampled splitters (a string and a place) range-
   partition them; every bucket sorts by multikey quicksort over tokens of 8 bytes; neighbours whose bytes agree on the whole
   length are repeats of the first. Equal suffixes may lie on both sides of a boundary, so each bucket's first suffix is
   compared with the last one of the bucket before.

Bytes move as one packed row for each task and bucket. Before any shuffle each task keeps the first of equal runs and equal
suffixes, so a passage that a third of all documents share costs a row a task; grams that meet several runs within a task are
dealt by gram and run, with one mark for the others, so an often used edge of a passage does not pile up either.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .hashing import Prefixes, U, mix

GRAM = 32
PIECE = 1 << 20
_PLACE = U((1 << 22) - 1)
#: Rows without an id have keys from here up to _REAL, told by their texts.
_NULL, _REAL = -(1 << 63), -(1 << 63) + (1 << 61)
#: Suffixes that a task sorts at a time.
SLICE = 1 << 17

# Rows between the steps: a packed row has bucket and data, a range row has key, copy, a, b; wanted tells ranges of window
# starts that are to be sorted (true) from ranges of bytes that go (false).
_ROWS = "bucket int, data binary, key long, copy int, a long, b long, wanted boolean"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]


def _batch(bucket, data, key, copy, a, b, wanted) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((bucket, data, key, copy, a, b, wanted), _KINDS, strict=True)], names=_NAMES)


def _ranges(key, copy, a, b, wanted: bool, buckets: int) -> pa.RecordBatch:
    n = len(key)
    at = (mix(np.asarray(key, np.int64).astype(U)) % U(buckets)).astype(np.int32)
    return _batch(at, [None] * n, key, copy, a, b, np.full(n, wanted))


def _packed(bucket: np.ndarray, fields: list[np.ndarray], raw: int) -> pa.RecordBatch:
    """A row for each bucket. The first `raw` fields are hashes, kept as 6 bytes; the others are compressed."""
    order = np.argsort(bucket, kind="stable")
    bucket, fields = bucket[order], [f[order] for f in fields]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True):
        parts = [np.ascontiguousarray(f[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for f in fields[:raw]]
        rest = b"".join(np.ascontiguousarray(f[a:b].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for f in fields[raw:])
        rows.append(int(b - a).to_bytes(8, "little") + b"".join(parts) + zlib.compress(rest, 1))
    n = len(rows)
    return _batch(bucket[first].astype(np.int32), rows, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n)


def _unpacked(rows: list[bytes], raw: int, rest: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(raw + rest)]
    for row in rows:
        n, at = int.from_bytes(row[:8], "little"), 8
        for f in range(raw):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(row, np.uint8, 6 * n, at).reshape(n, 6)
            out[f].append(wide.view("<u8")[:, 0])
            at += 6 * n
        data = np.frombuffer(zlib.decompress(row[at:]), np.uint8).reshape(rest, 8, n)
        for f in range(rest):
            out[raw + f].append(np.ascontiguousarray(data[f].T).view("<i8")[:, 0])
    return [np.concatenate(x) if x else np.zeros(0, U if f < raw else np.int64) for f, x in enumerate(out)]


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (key, copy, other columns...) from rows sorted by key: rows with one key are numbered in the order of their
    texts. A list holds some MB of text."""
    run: list[tuple] = []
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rest = [c.to_pylist() for c in part.columns[2:]]
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), *rest, strict=True):
                if run and run[0][0] != row[0]:
                    out += _numbered(run)
                    run = []
                    if size > 12 * PIECE:
                        yield out
                        out, size = [], 0
                run.append((row[0], (row[1] or "").encode(), *row[2:]))
                size += len(run[-1][1])
    yield out + _numbered(run)


def _numbered(run: list[tuple]) -> list[tuple]:
    if len(run) > 1:
        run.sort(key=lambda r: r[1])
    return [(r[0], k, *r[1:]) for k, r in enumerate(run)]


def _pieces(docs: list[tuple], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of bounded size: the bytes, and for each section of a document the document's number, where it starts in the
    document and where in the buffer. Long documents come in sections that overlap by length - 1 bytes."""
    own, size = [], 0
    for number, d in enumerate(docs):
        text = d[2]
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PIECE):
            own.append((number, at, text[at : at + PIECE + length - 1]))
            size += len(own[-1][2])
            if size >= PIECE:
                yield _joined(own)
                own, size = [], 0
    if own:
        yield _joined(own)


def _joined(own: list[tuple]):
    sizes = np.array([len(x[2]) for x in own])
    return np.frombuffer(b"".join(x[2] for x in own), np.uint8), np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.cumsum(sizes) - sizes


def _anchored(buffer: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: gram hash, run hash, first window start and number of windows, by buffer place."""
    p = Prefixes(buffer)
    grams = p.hash(slice(0, len(buffer) - GRAM + 1), slice(GRAM, len(buffer) + 1))
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)  # the leftmost of the smallest
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    sizes = np.append(first[1:], len(buffer)) - first
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[first] += 1
    np.add.at(inside, first + sizes - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(least)])
    anchor = (least[starts] & _PLACE).astype(np.int64)
    at = np.flatnonzero(_new(anchor))
    n = np.append(at[1:], len(anchor)) - at
    a, s = anchor[at], starts[at]
    runs = p.hash(s, s + n + (length - 1)) ^ mix(((a - s) * 256 + n).astype(U))
    return grams[a], runs, s, n


def _find_anchors(length: int, buckets: int):
    """Flags of packed rows: 0 the task saw the gram in one run only, 1 in several (dealt by gram and run), 2 the mark
    that tells rows of flag 0 elsewhere about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            found = []
            for buffer, number, base, first in _pieces(docs, length):
                gram, runs, s, n = _anchored(buffer, first, length)
                owner = np.searchsorted(first, s, "right") - 1
                found.append((gram >> U(16), runs >> U(16), number[owner], s - first[owner] + base[owner], n))
            if not found:
                continue
            gram, runs, doc, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, copies = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
            order = np.lexsort((runs, gram))  # stable: within a run by document and place
            gram, runs, doc, start, n = (x[order] for x in (gram, runs, doc, start, n))
            new_gram, new_run = _new(gram), _new(gram, runs)
            again = np.flatnonzero(~new_run)
            # neighbouring ranges of a document are one
            again = again[np.lexsort((start[again], doc[again]))]
            d, a, b = doc[again], start[again], start[again] + n[again] + length - 1
            merged = _merged(d, a, b)
            yield _ranges(keys[merged[0]], copies[merged[0]], merged[1], merged[2], False, buckets)
            group = np.cumsum(new_gram) - 1
            several = np.bincount(group, new_run)[group] > 1
            mark = new_gram & several
            kept = np.flatnonzero(new_run)
            flag = several[kept].astype(np.int64)
            g, r = np.append(gram[kept], gram[mark]), np.append(runs[kept], np.zeros(mark.sum(), U))
            flag = np.append(flag, np.full(mark.sum(), 2))
            where = np.append(kept, np.flatnonzero(mark))
            bucket = (mix(np.where(flag == 1, g ^ mix(r), g)) % U(buckets)).astype(np.int64)
            o = np.argsort(where, kind="stable")
            o = o[np.lexsort((start[where[o]], doc[where[o]]))]  # by document and place: packs better
            w = where[o]
            yield _packed(bucket[o], [g[o], r[o], keys[doc[w]], copies[doc[w]], start[w], n[w], flag[o]], 2)

    return run


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ranges with those that touch joined; ranges of a document that start later must not end earlier."""
    if not len(doc):
        return doc, a, b
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    return doc[first], a[first], np.maximum.reduceat(b, first)


def _split(batches: Iterator[pa.RecordBatch], out: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Passes range rows on and gathers packed ones."""
    for batch in batches:
        data = batch.column(1)
        out += [x.as_py() for x in data if x.is_valid]
        ranges = batch.filter(data.is_null())
        if ranges.num_rows:
            yield ranges


def _settle_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        yield from _split(batches, packed)
        if not packed:
            return
        gram, runs, key, copy, start, n, flag = _unpacked(packed, 2, 5)
        deal = flag == 1
        group = np.where(deal, mix(gram ^ mix(runs)), gram)  # what has to meet
        order = np.lexsort((deal, group))
        new = _new(group[order], deal[order])
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        keep = order[(np.repeat(size, size) > 1) | deal[order]]  # a gram that is alone cannot repeat
        gram, runs, key, copy, start, n, flag = (x[keep] for x in (gram, runs, key, copy, start, n, flag))
        order = np.lexsort((start, copy, key, runs, gram, flag == 1))
        gram, runs, key, copy, start, n, flag = (x[order] for x in (gram, runs, key, copy, start, n, flag))
        deal, mark = flag == 1, flag == 2
        new_gram, new_run = _new(deal, gram), _new(deal, gram, runs, mark)
        group = np.cumsum(new_gram) - 1
        different = np.bincount(group, new_run & ~mark)[group] if len(group) else group
        marked = np.bincount(group, mark)[group] > 0 if len(group) else group
        wanted = new_run & ~mark & (deal | marked | (different > 1))
        again = ~new_run & ~mark
        yield _ranges(key[again], copy[again], start[again], start[again] + n[again] + length - 1, False, buckets)
        yield _ranges(key[wanted], copy[wanted], start[wanted], start[wanted] + n[wanted], True, buckets)

    return run


def _wanted(docs: list[tuple], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the document, place of the section, its bytes, starts of wanted windows in it), section by section."""
    for number, (_, copy, text, ranges) in enumerate(docs):
        own = [(r["a"], r["b"]) for r in ranges or () if r["copy"] == copy]
        for at in range(0, len(text), PIECE):
            here = [(max(a, at), min(b, at + PIECE)) for a, b in own if a < at + PIECE and b > at]
            if here:
                buffer = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - at), at)
                yield number, at, buffer, np.concatenate([np.arange(a - at, b - at) for a, b in here])


def _joined_starts(key: np.ndarray, copy: np.ndarray, start: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """key, copy, first and last start of runs of starts, sorted, of one row each that are at most `reach` apart."""
    o = np.lexsort((start, copy, key))
    k, c, s = key[o], copy[o], start[o]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] > s[:-1] + reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1 if len(first) else first
    return k[first], c[first], s[first], s[last]


def _find_windows(length: int, buckets: int):
    """Of equal hashes within a task the windows stay at once, and a mark (start -1) tells the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            found = [(Prefixes(buffer).hash(s, s + length) >> U(16), np.full(len(s), number), s + at) for number, at, buffer, s in _wanted(docs, length)]
            if not found:
                continue
            value, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, copies = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
            order = np.argsort(value, kind="stable")
            new = _new(value[order])
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            several = np.repeat(size, size) > 1
            stay, mark, ask = order[several], order[several & new], order[~several]
            k, c, a, b = _joined_starts(keys[doc[stay]], copies[doc[stay]], start[stay], 1)
            yield _ranges(k, c, a, b + 1, True, buckets)
            ask.sort()  # by document and place: packs better
            at = np.concatenate([ask, mark])
            where = np.concatenate([start[ask], np.full(len(mark), -1)])
            yield _packed((mix(value[at]) % U(buckets)).astype(np.int64), [value[at], keys[doc[at]], copies[doc[at]], where], 1)

    return run


def _settle_windows(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        yield from _split(batches, packed)
        if not packed:
            return
        value, key, copy, start = _unpacked(packed, 1, 3)
        order = np.argsort(value, kind="stable")
        size = np.diff(np.append(np.flatnonzero(_new(value[order])), len(order)))
        stay = order[np.repeat(size, size) > 1]
        stay = stay[start[stay] >= 0]
        k, c, a, b = _joined_starts(key[stay], copy[stay], start[stay], 1)
        yield _ranges(k, c, a, b + 1, True, buckets)

    return run


def _tokens(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers of 8 bytes, which sort like them."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    wide[:, : strings.shape[1]] = strings
    return wide.view(">u8").astype(U)


def multikey_quicksort(tokens: np.ndarray, small: int = 256) -> np.ndarray:
    """The order of rows of tokens. Rows are parted by one token into smaller, equal and larger ones; equal ones go on with
    the next token. Short ranges are sorted by all tokens that are left."""
    order = np.arange(len(tokens))
    width = tokens.shape[1]
    ranges = [(0, len(tokens), 0)]
    while ranges:
        low, high, depth = ranges.pop()
        if high - low < 2 or depth == width:
            continue
        own = order[low:high]
        if high - low <= small:
            order[low:high] = own[np.lexsort(tokens[own, depth:].T[::-1])]
            continue
        column = tokens[own, depth]
        pivot = np.partition(column[:: max(1, len(column) // 9)], 4)[4]
        less, more = column < pivot, column > pivot
        n_less, n_more = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate([own[less], own[~(less | more)], own[more]])
        ranges += [(low, low + n_less, depth), (low + n_less, high - n_more, depth + 1), (high - n_more, high, depth)]
    return order


def _sortable(strings: np.ndarray, key: np.ndarray, copy: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A string and its place as one value that sorts by the string, then the place."""
    n, length = strings.shape
    both = np.ones((n, length + 25), np.uint8)  # the last byte keeps zeros from being stripped
    both[:, :length] = strings
    for k, x in enumerate((key.astype(np.int64) ^ np.int64(_NULL), copy, start)):
        both[:, length + 8 * k : length + 8 * (k + 1)] = x.astype(">i8").view(np.uint8).reshape(n, 8)
    return both.view(f"S{length + 25}").reshape(-1)


def _packed_strings(bucket: np.ndarray, strings: np.ndarray, fields: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket; bucket does not fall."""
    first = np.flatnonzero(_new(bucket))
    rows = []
    for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True):
        rest = b"".join(np.ascontiguousarray(f[a:b].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for f in fields)
        rows.append(int(b - a).to_bytes(8, "little") + zlib.compress(strings[a:b].tobytes() + rest, 1))
    n = len(rows)
    return _batch(bucket[first].astype(np.int32), rows, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n)


def _unpacked_strings(rows: list[bytes], length: int, fields: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(fields + 1)]
    for row in rows:
        n, data = int.from_bytes(row[:8], "little"), zlib.decompress(memoryview(row)[8:])
        out[0].append(np.frombuffer(data, np.uint8, n * length).reshape(n, length))
        rest = np.frombuffer(data, np.uint8, offset=n * length).reshape(fields, 8, n)
        for f in range(fields):
            out[f + 1].append(np.ascontiguousarray(rest[f].T).view("<i8")[:, 0])
    return [np.concatenate(x) for x in out]


def _suffixes(strings: np.ndarray, key: np.ndarray, copy: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by bytes, then place, and where a sorted one differs from the one before."""
    tokens = _tokens(strings)
    order = multikey_quicksort(tokens)
    same = (tokens[order[1:]] == tokens[order[:-1]]).all(1)
    new = np.append(True, ~same)
    tied = np.append(same, False) | ~new
    at = np.flatnonzero(tied)
    own = order[at]
    order[at] = own[np.lexsort((start[own], copy[own], key[own], np.cumsum(new)[at]))]
    return order, new


def _find_suffixes(length: int, buckets: int, wall: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            held: list[tuple] = []
            size = 0
            for number, at, buffer, s in _wanted(docs, length):
                for k in range(0, len(s), SLICE):
                    own = s[k : k + SLICE]
                    n = len(own)
                    held.append((buffer[own[:, None] + np.arange(length)], np.full(n, docs[number][0]), np.full(n, docs[number][1]), own + at))
                    size += n
                    if size >= SLICE:
                        yield from dealt(held)
                        held, size = [], 0
            if held:
                yield from dealt(held)

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        strings, key, copy, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order, new = _suffixes(strings, key, copy, start)
        again, kept = order[~new], order[new]
        k, c, a, b = _joined_starts(key[again], copy[again], start[again], length)
        yield _ranges(k, c, a, b + length, False, buckets)
        strings, key, copy, start = (x[kept] for x in (strings, key, copy, start))
        bucket = np.searchsorted(wall, _sortable(strings, key, copy, start), "right")
        yield _packed_strings(bucket, strings, [key, copy, start])

    return run


def _settle_suffixes(length: int, buckets: int):
    """Ranges, and for each bucket a row with its first and last string and the first one's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packed = None, []
        for batch in batches:
            for k, (mark, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if not row.is_valid:
                    yield batch.slice(k, 1)
                    continue
                if mark != bucket and packed:
                    yield from settled(bucket, packed)
                    packed = []
                bucket = mark
                packed.append(row.as_py())
        if packed:
            yield from settled(bucket, packed)

    def settled(bucket: int, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        strings, key, copy, start = _unpacked_strings(packed, length, 3)
        order, new = _suffixes(strings, key, copy, start)
        again = order[~new]
        k, c, a, b = _joined_starts(key[again], copy[again], start[again], length)
        yield _ranges(k, c, a, b + length, False, buckets)
        one = order[0]
        yield _batch([bucket], [strings[one].tobytes() + strings[order[-1]].tobytes()], [key[one]], [copy[one]], [start[one]], [start[one] + length], [False])

    return run


def _across(settled: DataFrame, length: int) -> DataFrame:
    """The ranges of buckets' first suffixes that are the last one of the bucket before. One row a bucket goes to one task."""
    edges = settled.where("data is not null")
    before = F.lag("data").over(Window.orderBy("bucket"))
    return edges.withColumn("before", before).where(F.substring("data", 1, length) == F.substring("before", length + 1, length)).select("key", "copy", "a", "b")


def _splitters(docs: DataFrame, length: int, buckets: int, sample_rows: int = 20_000) -> np.ndarray:
    """What parts `buckets` buckets, from one string each of a bounded sample of texts: for each of sample_rows slots that
    texts are dealt to by hash, the one with the smallest hash. They only balance."""
    h, size = F.xxhash64("key", F.lit(1)), F.length("text")
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("key", F.lit(2)), F.greatest(size - length, F.lit(1))) + 1).cast("int"), F.lit(length))
    rows = docs.where(size >= length).select(F.pmod(h, F.lit(sample_rows)).alias("slot"), F.struct(h.alias("h"), piece.alias("piece"), "key").alias("x"))
    found = rows.groupBy("slot").agg(F.min("x").alias("x")).select("x.piece", "x.key").collect()
    strings = np.frombuffer(b"".join(r["piece"].encode()[:length] for r in found), np.uint8).reshape(-1, length)
    zeros = np.zeros(len(found), np.int64)
    all_ = np.sort(_sortable(strings, np.array([r["key"] for r in found], np.int64), zeros, zeros))
    return all_[np.linspace(0, len(all_) - 1, buckets + 1).astype(np.int64)[1:-1]] if len(all_) else all_


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """What is left of every document (doc_id, text) when each byte is removed that a `length`-byte string covers which
    also starts earlier: in a smaller doc_id, or in the same document before. Strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (the ranges, in order).

    Texts are UTF-8 bytes; null is empty. Whole runs are told apart by 112-bit hashes, suffixes by their bytes. Null ids come
    first, in the order of a hash of their texts; rows that share an id are in the order of their texts. Ids below
    -2**63 + 2**61 count as null. Texts shorter than length stay whole. An empty table gives no row. Other columns are
    ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    text = F.col("text").cast("string")
    unknown = F.lit(_NULL).cast("long") + F.shiftrightunsigned(F.xxhash64(text), 3)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), unknown).alias("key"), text.alias("text"))
    base = rows.repartition(n, "key")

    def with_ranges(ranges: DataFrame, how: str) -> DataFrame:
        per = ranges.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("copy", "a", "b")).alias("ranges"))
        return base.join(per, F.col("key") == F.col("k"), how).select("key", "text", "ranges").sortWithinPartitions("key")

    dealt = base.sortWithinPartitions("key").mapInArrow(_find_anchors(length, buckets), _ROWS).repartition(n, "bucket")
    anchors = written(dealt.mapInArrow(_settle_anchors(length, buckets), _ROWS).select("key", "copy", "a", "b", "wanted"), release=True)
    dealt = with_ranges(anchors.where("wanted"), "inner").mapInArrow(_find_windows(length, buckets), _ROWS).repartition(n, "bucket")
    windows = written(dealt.mapInArrow(_settle_windows(length, buckets), _ROWS), release=True)
    wall = _splitters(rows, length, buckets)
    dealt = with_ranges(windows, "inner").mapInArrow(_find_suffixes(length, buckets, wall), _ROWS).repartition(n, "bucket").sortWithinPartitions("bucket")
    settled = written(dealt.mapInArrow(_settle_suffixes(length, buckets), _ROWS), release=True)
    gone = [anchors.where("not wanted"), settled.where("data is null"), _across(settled, length)]
    ranges = gone[0].select("key", "copy", "a", "b").unionByName(gone[1].select("key", "copy", "a", "b")).unionByName(gone[2])
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            out = []
            for key, copy, text, found in docs:
                own = sorted((r["a"], r["b"]) for r in found or () if r["copy"] == copy)
                spans: list[list[int]] = []
                for a, b in own:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                sha, at = hashlib.sha256(), 0
                for a, b in spans:
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                out.append((key, len(text), sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string(), span]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    done = with_ranges(ranges, "left").mapInArrow(cut, schema)
    return done.select(F.when(F.col("key") >= _REAL, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
