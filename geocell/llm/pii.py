"""Personal data: pattern matches, widened by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SHAPES = 4096
#: A word that meets this share of the documents with personal data, away from its own span, is known as a common one.
COMMON = 5e-4
#: Longer words have no such count.
LONGEST = 64
#: Marks of learn()'s rows that count no shape.
DOCUMENTS, WORDS = -100, -101

_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = re.compile(r"[\W_]+")
_GROUP = re.compile(r"[^\w]*[0-9][^\w]*(?:[0-9]+[^\w]*)*")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign is tried once, from the start of the run before it: linear, unlike the plain pattern."""
    done = 0
    for run in _RUN.finditer(text):
        at = run.end()
        start = max(run.start(), done)
        if start < at and text[at : at + 1] == "@" and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts each, from the left of every dotted chain."""
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") >= 3:
            parts = [m.span() for m in _NUMBER.finditer(text, *chain.span())]
            for k in range(0, len(parts) - 3, 4):
                own = parts[k : k + 4]
                if all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or "0") <= 255 for a, b in own):
                    yield own[0][0], own[3][1]


def _digits(text: str) -> str:
    return "".join(re.findall("[0-9]", text))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kind by kind, each from the left."""
    if not _HINT.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---- the field -----------------------------------------------------------------------------------------------------


def _shape(word: str) -> int:
    s = re.sub("[a-z]+", "a", re.sub("[0-9]", "0", word.translate(_LOW)))
    return zlib.crc32(s[:32].encode()) % SHAPES


def _key(word: str) -> str:
    return _MARKS.sub("", word.translate(_LOW))


def _keys(word: str) -> list[str]:
    """What a word has in common with another spelling of it."""
    parts = [word, word[: word.index("@")]] if "@" in word else [word]
    return [k for k in dict.fromkeys(map(_key, parts)) if k]


def _held(text: str, spans: list[tuple[str, int, int]], words: list[tuple[int, int]]) -> tuple[dict[str, int], set[str]]:
    """Keys of the words in base spans, each with the first such word, and the keys that several groups of digits make.

    An address has itself and its local part. A number has each of its groups, and these joined from any group on.
    """
    keys: dict[str, int] = {}
    joined: set[str] = set()
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    for kind, a, b in spans:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        if kind == "email":
            own = [(first, k) for k in _keys(text[a:b])]
        elif kind == "ip":
            own = [(first, _key(text[a:b]))]
        else:
            groups = [(i, _digits(text[max(a, starts[i]) : min(b, ends[i])])) for i in range(first, last)]
            groups = [g for g in groups if g[1]]
            tails = [(groups[j][0], "".join(d for _, d in groups[j:])) for j in range(len(groups))]
            joined.update(d for _, d in tails)
            own = groups + tails
        for i, k in own:
            if k:
                keys.setdefault(k, i)
    return keys, joined


def _mentions(text: str, words: list[tuple[int, int]], labels: np.ndarray, keys: dict[str, int], joined: set[str]) -> Iterator[tuple[int, int, str]]:
    """(word in a base span, other word, key) wherever a word outside, or a run of digit groups, has a key of a span."""
    for i, (a, b) in enumerate(words):
        if not labels[i]:
            for k in _keys(text[a:b]):
                if k in keys:
                    yield keys[k], i, k
    if joined:
        heads = {d[:n] for d in joined for n in range(1, len(d) + 1)}
        for i in range(len(words)):
            own, j = "", i
            while j < len(words) and not labels[j] and _GROUP.fullmatch(text, *words[j]):
                own += _digits(text[words[j][0] : words[j][1]])
                if own not in heads:
                    break
                j += 1
                if own in joined and j - i > 1:
                    for w in range(i, j):
                        yield keys[own], w, own


def _nodes(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Words, and for each the label of the first base span that overlaps it (0: none)."""
    words = [m.span() for m in _WORD.finditer(text)]
    labels = np.zeros(len(words), np.int64)
    starts = np.array([w[0] for w in words])
    ends = np.array([w[1] for w in words])
    for kind, a, b in reversed(spans):
        labels[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = LABELS.index(kind)
    return words, labels


def learn(docs: DataFrame) -> dict:
    """Label counts of word shapes and of neighbours, and how words that a base span has are used without one, over every
    document that has a base span.

    The tables' sizes are bounded, whatever the corpus: shapes are hashed to SHAPES rows, and a word is in the last table
    if it comes without its span COMMON times as often as there are such documents. Its skip potential falls by the log of
    the share of its uses that are beside a span of its own; a rarer word's is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for cell in batch.column(0):
                text = cell.as_py() or ""
                if spans := base_spans(text):
                    words, labels = _nodes(text, spans)
                    seen[(DOCUMENTS, 0, None)] += 1
                    seen.update((_shape(text[a:b]), int(x), None) for (a, b), x in zip(words, labels, strict=True))
                    seen.update((-1 - int(x), int(y), None) for x, y in zip(labels, labels[1:], strict=False))
                    keys, _ = _held(text, spans, words)
                    for (a, b), x in zip(words, labels, strict=True):
                        if not x and b - a <= LONGEST:
                            seen.update((WORDS, int(k in keys), k) for k in _keys(text[a:b]))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))] + [pa.array([seen[k] for k in rows], pa.int64())], names=["shape", "label", "word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "shape int, label int, word string, n long").groupBy("shape", "word").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(x) for k, x in enumerate(LABELS)])
    counted = written(counted)
    found = counted.where("word is null").collect()
    documents = sum(r["none"] for r in found if r["shape"] == DOCUMENTS)
    # label 0: away from a span of its own, label 1: beside one
    often = counted.where(F.col("word").isNotNull() & (F.col("none") >= max(3, COMMON * documents))).select("word", "none", LABELS[1]).collect()
    common = {r[0]: float(np.log((r[2] + 1) / (r[1] + r[2] + 1))) for r in often}
    rows = [(r["shape"], k, r[x]) for r in found if r["shape"] != DOCUMENTS for k, x in enumerate(LABELS) if r[x]]
    shapes, pairs = np.zeros((SHAPES, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    for shape, label, n in rows:
        (shapes if shape >= 0 else pairs)[shape if shape >= 0 else -1 - shape, label] = n
    prior = (shapes.sum(0) + 1) / (shapes.sum() + len(LABELS))
    chance = (shapes + 2 * prior) / (shapes.sum(1, keepdims=True) + 2)
    unary = np.log(np.clip(chance, 0.01, 1))
    unary[:, 1:] = np.minimum(unary[:, 1:], np.log(0.1))  # a shape alone never names a word personal
    unary[:, 0] = np.log(np.clip(chance[:, 0], 0.9, 1))
    both = (pairs + prior[:, None] * prior) / (pairs.sum() + 1)
    chain = np.clip(np.log(both / (both.sum(1, keepdims=True) * both.sum(0, keepdims=True))), -1, 1)
    return {"unary": unary, "chain": chain, "common": common}


def field_spans(text: str, spans: list[tuple[str, int, int]], model: dict, skip: float = 6.0, rounds: int = 12) -> list[tuple[str, int, int]]:
    """The spans that the field adds to the base ones.

    Nodes are words. Words in a base span are held to its kind. Neighbours share the chain potentials. Every word that has
    a key of a base span shares a skip potential with a word of that span: one edge for each such word and span key, so
    distance does not matter. Longer words with a digit also share one with the next word of the same key. An edge is
    as strong as learn() found the key to be used beside its span. Loopy sum-product passes run until the beliefs settle,
    `rounds` times at most.
    """
    words, labels = _nodes(text, spans)
    common = model["common"]
    links: dict[tuple[int, int], float] = {}
    keys, joined = _held(text, spans, words)
    for i, j, key in _mentions(text, words, labels, keys, joined):
        pair = min(i, j), max(i, j)
        links[pair] = max(links.get(pair, 0.0), skip + common.get(key, 0.0))
    last: dict[str, int] = {}
    for i, (a, b) in enumerate(words):
        if b - a >= 5 and _NUMBER.search(text, a, b):
            for key in _keys(text[a:b]):
                if len(key) >= 5:
                    if key in last:
                        pair = last[key], i
                        links[pair] = max(links.get(pair, 0.0), skip + common.get(key, 0.0))
                    last[key] = i
    links = {pair: x for pair, x in links.items() if x > 0}
    if not any(labels[i] == 0 or labels[j] == 0 for i, j in links):
        return []  # every repeated word is in a base span already: nothing can be added
    n, k = len(words), len(LABELS)
    unary = model["unary"][[_shape(text[a:b]) for a, b in words]].copy()
    held = labels > 0
    unary[held] = -30.0
    unary[held, labels[held]] = 0.0
    skips = np.array(sorted(links), np.int64).reshape(-1, 2)
    strength = np.array([links[i, j] for i, j in skips.tolist()])
    left = np.concatenate([np.arange(n - 1), skips[:, 0]])
    right = np.concatenate([np.arange(1, n), skips[:, 1]])
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    m = len(left)
    agree = np.eye(k) * (np.arange(k) > 0)
    forward = np.exp(np.concatenate([np.broadcast_to(model["chain"], (n - 1, k, k)), strength[:, None, None] * agree]))
    potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    sent = np.zeros((2 * m, k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, sent)
        out = belief[source] - sent[back]
        out = np.einsum("ei,eij->ej", np.exp(out - out.max(1, keepdims=True)), potential)
        new = np.log(out / out.sum(1, keepdims=True))
        if np.abs(new - sent).max() < 1e-4:
            break
        sent = 0.5 * sent + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, target, sent)
    best = belief.argmax(1)
    added: list[tuple[str, int, int]] = []
    for i in np.flatnonzero((best > 0) & ~held):
        a, b = words[i]
        trimmed = text[a:b].rstrip(".,;:!?)]}\"'")
        start = a + len(trimmed) - len(trimmed.lstrip("([{\"'"))
        added.append((LABELS[best[i]], start, a + len(trimmed)))
    return [s for s in added if s[1] < s[2]]


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Personal data in every text of docs (doc_id, text): counts and digest of the base spans, and all spans; n_added spans
    come from the field, n_spans from both.

    Null text is empty: no spans, the digest of the empty string. A null doc_id stays null; repeated rows repeat. Time
    is linear in the text but for sorting; there is no limit on a text's length. Documents without a base span have
    nothing that the field could spread. An empty table gives no row. Other columns are ignored.
    """
    model = learn(docs) if model is None else model
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spelled, more, every = [], [], [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                added = field_spans(text, base, model) if base else []
                for own, kind in zip(counts, KINDS, strict=True):
                    own.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spelled.append(spell(base + added))
                more.append(len(added))
                every.append(len(base) + len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spelled, pa.string()), pa.array(more, pa.int64()), pa.array(every, pa.int64())], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """docs with personal data in the text column masked; null stays null, all columns stay."""
    model = learn(docs.select(F.col(text).alias("text"))) if model is None else model

    @F.pandas_udf("string")
    def mask(column):
        def one(x):
            base = base_spans(x) if x else []
            return masked(x, base + field_spans(x, base, model)) if base else x

        return column.map(one)

    return docs.withColumn(text, mask(F.col(text).cast("string")))
