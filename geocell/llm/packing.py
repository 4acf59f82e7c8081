"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Documents whose remainders are packed together; it bounds a task's memory, not what is packed.
BATCH_IDS = 4_000_000


class _Packer:
    """Packs (document, ids) of one task.

    Every document gives whole windows of the longest tier; what remains goes to the smallest tier it fits. A window of
    a tier is opened by its longest waiting remainder and its gap is filled by the longest shorter ones that fit, then by
    the head of one that is cut. So all windows are full; what fills none waits for the next batch. At the end of the task
    what is left and the first windows are cut anew: into full windows and one sequence that lacks less than the shortest
    tier, the only one that needs padding.

    Step groups hold windows of one tier, group_tokens ids each as nearly as their number allows. Windows are dealt to the
    groups of a batch in turn, there and back, by falling cost (the sum of squared piece lengths, as attention has it).
    """

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, base: int):
        self.tiers = sorted(tiers, reverse=True)
        self.group_tokens, self.base = group_tokens, base
        self.numbers = count()
        self.groups = dict.fromkeys(self.tiers, 0)
        self.windows: dict[int, list[tuple[int, int]]] = {}  # tier: (cost, sequence) since the last rows()
        self.spare: list[tuple] = []  # pieces of the first windows, one of the longest tier's size together
        self.room = self.tiers[0]
        self.left: list[tuple] = []
        self.out: list[tuple] = []

    def sequence(self, pieces: list[tuple], tier: int) -> None:
        """pieces: (document, start, length), in order. Documents are (doc_id, ids as bytes)."""
        if self.room > 0:
            self.spare += pieces
            self.room -= tier
            return
        number, offset = self.base + next(self.numbers), 0
        for (doc_id, ids), start, length in pieces:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            self.out.append((doc_id, start, length, crc, len(ids) // 4, number, offset, tier))
            offset += length
        self.windows.setdefault(tier, []).append((sum(p[2] * p[2] for p in pieces), number))

    def pack(self, documents: list[tuple]) -> None:
        top = self.tiers[0]
        waiting = [(n, -1, doc, start) for doc, start, n in self.left]  # (length, order, document, start), sorted
        for order, doc in enumerate(documents):
            n = len(doc[1]) // 4
            for at in range(0, n - top + 1, top):
                self.sequence([(doc, at, top)], top)
            if n % top:
                waiting.append((n % top, order, doc, n - n % top))
        waiting.sort(key=lambda x: x[:2])
        self.left = []
        while waiting:
            length, _, doc, start = waiting.pop()
            tier = min(t for t in self.tiers if t >= length)
            pieces, gap = [(doc, start, length)], tier - length
            while gap and waiting:
                k = bisect_right(waiting, gap, key=lambda x: x[0]) - 1
                if k >= 0:
                    n, _, d, s = waiting.pop(k)
                else:  # all that waits is longer: cut the shortest
                    rest, o, d, s = waiting.pop(0)
                    n = gap
                    insort(waiting, (rest - n, o, d, s + n), key=lambda x: x[:2])
                pieces.append((d, s, n))
                gap -= n
            if gap:
                self.left = pieces
            else:
                self.sequence(pieces, tier)

    def finish(self) -> None:
        """Cuts the spare windows and what is left: windows of the tiers, and at most one sequence that is not full."""
        top, least = self.tiers[0], self.tiers[-1]
        pieces, self.spare, self.left, self.room = self.spare + self.left, [], [], 0
        total = sum(p[2] for p in pieces)
        if 0 < total < top:
            self.sequence(pieces, total if total & (total - 1) == 0 else top)
            return
        if total % least:
            self.sequence(_taken(pieces, top - least + total % least), top)
            total -= top - least + total % least
        for tier in self.tiers:
            while total >= tier:
                self.sequence(_taken(pieces, tier), tier)
                total -= tier

    def rows(self) -> pa.RecordBatch:
        group: dict[int, int | None] = {}
        for tier, windows in self.windows.items():
            if tier not in self.groups:
                group.update((number, None) for _, number in windows)
                continue
            n = max(1, round(len(windows) * tier / self.group_tokens))
            for k, (_, number) in enumerate(sorted(windows, reverse=True)):
                turn, place = divmod(k, n)
                group[number] = self.base + (tier << 16) + self.groups[tier] + (n - 1 - place if turn % 2 else place)
            self.groups[tier] += n
        columns = [*zip(*self.out, strict=True), [group[r[5]] for r in self.out]] if self.out else [()] * 9
        self.out, self.windows = [], {}
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _taken(pieces: list[tuple], need: int) -> list[tuple]:
    """The first `need` ids of the pieces, which lose them."""
    own = []
    while need:
        doc, start, length = pieces.pop(0)
        n = min(length, need)
        own.append((doc, start, n))
        need -= n
        if length > n:
            pieces.insert(0, (doc, start + n, length - n))
    return own


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), group_tokens: int = 16384) -> DataFrame:
    """One row per piece of a document (doc_id, text), with the sequence and the place in it where it goes.

    tiers: window sizes, powers of two. Each step group holds about group_tokens ids of windows of one tier, at like cost;
    its id is null for a task's whole input that is itself a shorter power of two. No shuffle: each task packs its own
    input partition, and leaves at most one sequence unfilled, by less than the shortest tier; a task with less than one
    long window has that one sequence. Sequence ids hold the partition's number, which a retried task keeps.

    Ids are the tokenizer's by default: a literal <|endoftext|> is one id. Null text is empty; an empty text is its end id
    alone. A null doc_id stays null. Repeated rows are packed as often as they come. A text of any length is cut into
    windows. An empty table gives no row. Other columns are ignored.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.cache(ranks_path, pattern)
        packer = _Packer(tiers, group_tokens, TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = tokens.encode_document(text.as_py() or "", ids) + end
                held.append((doc_id, own))
                size += len(own) // 4
                if size >= BATCH_IDS:
                    packer.pack(held)
                    yield packer.rows()
                    held, size = [], 0
        packer.pack(held)
        packer.finish()
        yield packer.rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
