"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocell.llm import language, lm, media, mixing, neardup, packing, pii, quality, suffixes, tokens, topk
from geocell.llm.common import held_out
from geocell.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, key string, row string"


def words(rng, n, stock=None):
    stock = stock or ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 200)) for _ in range(25)]
    near = [" ".join(w if k % 40 else "changed" for k, w in enumerate(t.split())) for t in base[:8]]
    passage = words(rng, 40)
    out = base + near + base[:6] + [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(6)]
    out += [None, "", " \t\n", "Oné twö", "a", "A", "ab" * 300, "x\x00" * 80, "mail me: bo.b42@mail.example.com, later bo.b42 again", words(rng, 9000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "de", None][k % 3], [None, "s1", "s2", "s3"][min(3, k % 7)], None if t is None else len(t), 0.5, 1, "k", "r") for k, t in enumerate(texts)]
    rows.append((None, "no id at all but some text here", "en", "s1", 3, None, None, None, None))
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        lm.score(e, held_out(7)), media.document_media(e), neardup.classes(e), neardup.keep_one(e), mixing.sample(e), quality.classify(e, labels, F.col("source"), F.col("lang")),
        language.identify(e, language.fit(e)), suffixes.deduplicate(e), packing.pack(e, *tokenizer()), pii.find(e), pii.redact(e),
        topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.count() == 0


def lower_words(t):
    return (t or "").encode().lower().split()


def test_lm_counts_and_base(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r) for w in [*lower_words(r.text), b"\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id if r.doc_id is not None else -1, held(r), len(lower_words(r.text)) + 1, sum(c[w] > 0 for w in [*lower_words(r.text), b"\n"]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*lower_words(r.text), b"\n"]), 6)) for r in rows)
    for options in ({}, {"words": 5, "grams": 50}):  # broadcasts of any size give the same
        got = lm.score(docs, held_out(7), depth=4, split=2, **options).collect()
        assert {r.train_tokens for r in got} == {n}
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        coded = {r.doc_id: len(b" ".join(lower_words(r.text))) + 1 for r in rows}
        assert all(r.n_coded == coded[r.doc_id] and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_coded) for r in got)
        scores = sorted((r.doc_id or -1, r.score) for r in got)
        assert options == {} or scores == [(i, pytest.approx(x, abs=1e-9)) for i, x in first]
        first = scores


def test_lm_is_context_tree_weighting(spark):
    """Depth 2, against a recursion over the tree."""
    text = "abab abba cab"
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = lm.score(df, F.lit(False), depth=2, split=1).first().score
    stream = b"\n\n" + text.encode() + b"\n"
    nodes = collections.defaultdict(lambda: [0, 0])
    events = []
    for i in range(2, len(stream)):
        for k in range(8):
            node, bit = (1 << k) | (stream[i] >> (8 - k)), (stream[i] >> (7 - k)) & 1
            events.append((stream[i - 2 : i], node, bit))
            for d in range(3):
                nodes[stream[i - d : i], node][bit] += 1

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = log_kt(*nodes[ctx, node])
        if len(ctx) == 2:
            return own
        below = sum(weighted(c, node) for c, m in list(nodes) if m == node and len(c) == len(ctx) + 1 and c[1:] == ctx)
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(below))

    def predict(full, node, d=0):
        ctx = full[2 - d :]
        a, b = nodes[ctx, node]
        p = (a + 0.5) / (a + b + 1)
        if d == 2:
            return p
        w = 0.5 * math.exp(log_kt(a, b) - weighted(ctx, node))
        return w * p + (1 - w) * predict(full, node, d + 1)

    want = sum(math.log10(predict(c, n) if bit == 0 else 1 - predict(c, n)) for c, n, bit in events)
    assert got == pytest.approx(want, abs=1e-4)


def test_media_round_trip(docs):
    got = {(r.doc_id, r.n_bytes): r for r in media.document_media(docs).collect()}
    assert media.document_media(docs).count() == docs.count()
    for r in docs.collect():
        raw = (r.text or "").encode()
        data = raw + bytes(-len(raw) % 64) or bytes(64)
        g = got[r.doc_id, len(raw)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        stored = media.store(data)
        assert media.load(stored).tobytes() == data and (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_interleave():
    html = '<p>One &amp; two<figure><img src="a.png" alt="x"><figcaption>Cap <b>t</b></figcaption></figure><script>no</script>after<img src="b.png">'
    assert [(i["position"], i["kind"], i["text"] or i["src"], i["caption"]) for i in media.parse(html)] == [(0, "text", "One & two", None), (1, "media", "a.png", "Cap t"), (2, "text", "after", None), (3, "media", "b.png", None)]
    assert media.parse(None) == media.parse("") == []


def grams(t, n=5):
    w = lower_words(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_classes(rows):
    """Class and number of links of each row (doc_id, text), by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    least = {r: min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for r, own in members.items()}
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))], members


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, docs, texts, block):
    # rows without an id beside rows with one, copies without any id, a repeated id with another text, repeated rows
    more = spark.createDataFrame([(None, texts[0]), (None, texts[1] + " more"), (None, "lone " + texts[9]), (None, "lone " + texts[9]), (4, texts[20]), (77, texts[6]), (77, texts[6])], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in df.collect()]
    want, members = near_classes(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in neardup.classes(df, block=block).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = collections.Counter(r.doc_id for r in neardup.keep_one(df).collect())
    assert sum(kept.values()) == len(members)
    assert kept == collections.Counter(min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for own in members.values())


def test_near_duplicate_recall(spark):
    """All pairs at the threshold or above in a driver table, by brute force."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, _ = near_classes(rows)
    got = {tuple(r) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(want)


def test_components(spark):
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)] + [(5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    from geocell.llm import graph

    for hot in (0.5, 0.01):
        got = graph.components(spark.createDataFrame(edges, "a long, b long"), hot=hot).collect()
        assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_band_choice():
    b, r = neardup.bands(0.8, 0.999, 96)
    assert b * r <= 96 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_mixing(docs):
    rows = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    got = mixing.mix(rows).collect()
    assert len(got) == docs.count()
    assert all(r.size == len(lower_words(t)) for r in got for t in [next(x.text for x in docs.collect() if x.doc_id == r.doc_id)])
    assert all(0 <= r.copies <= 3 for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(rows.repartition(5)).collect()))
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs).count() == sum(r.copies for r in got)


def test_sample_keeps_its_rows_when_splits_change(spark, tmp_path, monkeypatch):
    rows = spark.range(200).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', cast(1 + id % 7 as int)) as text")
    rows.repartition(6).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))).collect() if r.copies}
    name, mix = "spark.sql.files.maxPartitionBytes", mixing.mix
    old = spark.conf.get(name)

    def then_smaller(*args, **options):
        out = mix(*args, **options)
        spark.conf.set(name, "4m")  # a file each, not two
        return out

    monkeypatch.setattr(mixing, "mix", then_smaller)
    try:
        assert collections.Counter(r.doc_id for r in mixing.sample(docs).collect()) == want
    finally:
        spark.conf.set(name, old)


def test_targets_reach_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(1980 * 2 / 5) and got["c"] == pytest.approx(1980 * 3 / 5)


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(500)]
    v[7] = (7, v[8][1])
    v += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    ints = {i: np.floor(np.array(x) * 1024).astype(int) for i, x in v[:500]}
    want = {(q, k + 1, i, -s) for q in range(0, 500, 100) for k, (s, i) in enumerate(sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10])}
    assert {tuple(r) for r in topk.search(df, block=64, query_block=2).collect()} == want


def test_quality(spark):
    rng = random.Random(5)
    good = [(k, words(rng, 120), "en", "h1") for k in range(60)] + [(200, None, None, None), (201, "", "en", None)]
    bad = [(100 + k, "SPAM!! " * 120, "en", "h2") for k in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.classify(df, labels, F.col("source"), F.col("lang")).where("kept").collect()}
    assert set(range(60)) <= kept and not kept & set(range(100, 160))
    assert {r.doc_id for r in quality.keep_good(df, labels, F.col("source"), F.col("lang")).collect()} == kept


def test_sites_shrink(spark):
    rows = [("h", "p", 1.0)] * 50 + [("h", "rare", 0.0)] + [("g", "p", 0.0)] * 50
    got = {(r.host, r.path): r.posterior for r in quality.sites(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert got["h", "p"] > 0.9 and got["g", "p"] < 0.1 and got["h", "rare"] > 0.3


def test_language(spark, docs):
    rng = random.Random(6)
    a, b = ["".join(rng.choice(s) for _ in range(4)) for s in ["aeilmr"] * 50], ["".join(rng.choice(s) for _ in range(4)) for s in ["boktzu"] * 50]
    rows = [(k, words(rng, 80, (a, b)[k % 2]), ("xx", "yy")[k % 2]) for k in range(80)]
    fitted = language.fit(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows[60:] + [(90, None, None), (91, "12 34!", "xx")], "doc_id long, text string, lang string"), fitted).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows[60:])
    assert got[90].lang_pred == got[91].lang_pred == "und"
    assert language.identify(docs, fitted).count() == docs.count()


def removed(rows, n=100):
    seen, out = set(), []
    for _, _, raw in sorted(rows):
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(w)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffixes(docs):
    rows = docs.collect()
    ordered = sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()) for r in rows)
    want = collections.Counter((i if known else None, *x) for (known, i, _), x in zip(ordered, removed(ordered), strict=True))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs).collect())
    assert got == want


def test_suffixes_across_boundaries(spark, monkeypatch):
    """Buckets so small that equal suffixes lie on both sides of a boundary."""
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(k, f"{words(rng, rng.randint(0, 30))} {passage[rng.randint(0, 60):]}") for k in range(40)] + [(k, "y" * 150) for k in range(50, 56)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    once, again = set(), {}
    for i, t in rows:  # a boundary right before the second place of every string that repeats
        for at in range(len(t) - 99):
            string = t[at : at + 100].encode()
            if string in once:
                again.setdefault(string, (i, at))
            once.add(string)
    place, start = (np.array(x, np.int64) for x in zip(*again.values(), strict=True))
    strings = np.frombuffer(b"".join(again), np.uint8).reshape(-1, 100)
    wall = np.sort(suffixes._sortable(strings, place, np.zeros(len(again), np.int64), start))
    monkeypatch.setattr(suffixes, "_splitters", lambda *a, **k: wall)
    seen = []
    across = suffixes._across
    monkeypatch.setattr(suffixes, "_across", lambda *a: seen.append(across(*a)) or seen[0])
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, removed([(0, i, t.encode()) for i, t in rows]), strict=True))
    # small tables are read by one task, which settles all by itself; here several tasks must meet
    several = {f"spark.sql.{c}": "false" for c in ("adaptive.coalescePartitions.enabled", "adaptive.enabled")} | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in several}
    try:
        for c, value in several.items():
            spark.conf.set(c, value)
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(df).collect()) == want
        assert seen[0].count() > 0  # boundaries did matter
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_multikey_quicksort():
    rng = np.random.default_rng(6)
    for rows, most in ((0, 3), (1, 3), (700, 2), (3000, 5), (3000, 1 << 62)):
        t = rng.integers(0, most, (rows, 5), dtype=np.uint64)
        assert t[suffixes.multikey_quicksort(t, small=8)].tolist() == sorted(t.tolist())


def test_tokens_equal_the_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = tokens.cache(*tokenizer())
    for x in ["", " ", "a b", "a  b", " a\n b ", "it's 12 o'clock  \t x", "é  b  c ᠎ d", "<|endoftext|> x", "a \x1c b", "日本 語"]:
        assert np.frombuffer(tokens.encode(x, ids), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_tokens_equal_the_tokenizer_by_default(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = tokens.cache(*tokenizer())
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}x", f"a  {mark}\n b ", f"<{mark}>", mark[:-1], f"it's{mark}é 12", "", "a  b"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(tokens.encode_document(x, ids), "<u4").tolist() for x in texts] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), *tokenizer()).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {k: len(x) + 1 for k, x in enumerate(want)}


def test_packing(docs):
    path = tokenizer()
    ids = tokens.cache(*path)
    rows = packing.pack(docs, *path).collect()
    streams = [np.frombuffer(tokens.encode(r.text or "", ids) + b"\1\0\0\0", "<u4") for r in docs.collect()]
    assert sum(r.length for r in rows) == sum(map(len, streams))
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, own in ((r.doc_id, s) for r, s in zip(docs.collect(), streams, strict=True) if r.doc_id != 3):
        pieces = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[d])
        at = 0
        for start, n, crc, total in pieces:
            assert start == at and total == len(own) and crc == zlib.crc32(own[start : start + n].astype("<u4").tobytes())
            at += n
        assert at == len(own)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    of_task = collections.Counter(q >> 32 for q in sequences)
    for number, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        if at not in (256, 512, 1024, 2048):
            assert 2048 - 256 < at or of_task[number >> 32] == 1
            short += 1
    assert short <= docs.rdd.getNumPartitions()
    groups = collections.defaultdict(lambda: collections.defaultdict(int))
    for r in rows:
        groups[r.step_group, r.tier][r.sequence_id] += r.length**2
    for (_, tier), cost in groups.items():
        assert 1 <= len(cost) <= 1.5 * 16384 / tier


def test_packing_balances_step_groups():
    rng = random.Random(4)
    packer = packing._Packer((2048, 1024, 512, 256), 16384, 0)
    packer.pack([(k, bytes(4 * rng.choice([3, 40, 700, 2500, 9000]))) for k in range(2000)])
    packer.finish()
    t = packer.rows().to_pylist()
    cost, number = collections.defaultdict(int), collections.defaultdict(set)
    for r in t:
        cost[r["tier"], r["step_group"]] += r["length"] ** 2
        number[r["tier"], r["step_group"]].add(r["sequence_id"])
    for tier in {k[0] for k in cost}:
        sizes = [len(number[k]) for k in number if k[0] == tier]
        assert max(sizes) - min(sizes) <= 1
        costs = [cost[k] / len(number[k]) for k in cost if k[0] == tier]
        assert len(costs) == 1 or max(costs) - min(costs) <= 0.2 * max(costs)
    assert sum(r["length"] for r in t) == sum({r["doc_id"]: r["doc_tokens"] for r in t}.values())


def test_packing_of_little(spark):
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for texts, lengths in ((["a b"], [3]), (["a b c"], [4]), ([None], [1]), ([" a" * 2300], [256, 2045]), ([" a" * 2047], [2048])):
        rows = packing.pack(frame(texts), *tokenizer()).collect()
        by = collections.Counter()
        for r in rows:
            by[r.sequence_id] += r.length
        assert sorted(by.values()) == lengths


def test_pii_patterns():
    import re

    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "phone": lambda s: 8 <= len(digits(s)) <= 15,
        "card": lambda s: 16 <= len(digits(s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits(s)[::-1])) % 10 == 0,
    }
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["1", "25", "255", ".", ".", "@", "a", "b-", "_", "+", " ", "-", "(", "4111111111111111", "10.0.0.1", "a@b.co"]) for _ in range(rng.randint(0, 25)))
        want = [(k, *m.span()) for k, p in plain.items() for m in p.finditer(t) if rules[k](m.group())]
        assert pii.base_spans(t) == want, t


def test_pii_field_adds_and_keeps(docs):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = "mail me: bo.b42@mail.example.com, later bo.b42 again"
    r = next(x for x in got.values() if x.n_email == 1)
    a = text.index("bo.b42 again")
    assert r.spans.split(",") == [f"email:9:{9 + len('bo.b42@mail.example.com')}", f"email:{a}:{a + 6}"]
    assert r.base_sha256 == hashlib.sha256(r.spans.split(",")[0].encode()).hexdigest()
    assert (r.n_added, r.n_spans) == (1, 2) and all(x.n_spans == len(x.spans.split(",")) for x in got.values() if x.spans)
    assert all(x.spans == "" for x in got.values() if not x.n_email + x.n_ip + x.n_card + x.n_phone)
    masked = [x.text for x in pii.redact(docs).collect() if x.text and "[EMAIL]" in x.text]
    assert masked == ["mail me: [EMAIL], later [EMAIL] again"]


def added(text, model):
    return [(k, text[a:b]) for k, a, b in pii.field_spans(text, pii.base_spans(text), model)]


def test_pii_field_links_every_word_of_a_span(spark):
    rows = ["mail jane.doe@corp.org or info@corp.org", "for info write to bob@x.org, 4 49 30 lines", "call +49 (030) 123 4567 now"] + [f"more info and 49 facts, mail u{k}q@x.org" for k in range(40)]
    model = pii.learn(spark.createDataFrame(enumerate(rows), "doc_id long, text string"))
    far = "the cat sat " * 200
    assert added(f"Ask jane.doe@corp.org {far} as Jane.Doe, said", model) == [("email", "Jane.Doe")]
    assert added(f"Ask jane.doe@corp.org {'so jane.doe went ' * 60}", model) == [("email", "jane.doe")] * 60
    # what comes without its span in other documents is a common word
    assert added("mail info@corp.org for more info and info", model) == []
    assert added("call +49 (030) 123 4567 with 49 facts", model) == []
    assert added(f"call +49 (030) 123 4567 {far} or 49 (030) 123 4567", model) == [("phone", x) for x in ("49", "030", "123", "4567")]
    assert added(f"call +49 (030) 123 4567 {far} or (030) 1234567", model) == [("phone", "030"), ("phone", "1234567")]
    assert added(f"pay 4111 1111 1111 1111 {far} card of 4111", model) == [("card", "4111")]


def test_lm_runs_of_whole_shards():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(8) | rng.integers(0, 256, 3000).astype(np.uint64))
    n = rng.integers(0, 9, len(grams))
    runs = list(lm._runs(grams, n, 1, most=200))
    assert len(runs) > 5 and sorted(zip(*(np.concatenate(x).tolist() for x in zip(*runs, strict=True)), strict=True)) == list(zip(grams.tolist(), n.tolist(), strict=True))
    assert sum(len(set((k >> np.uint64(8)).tolist())) for k, _ in runs) == len(set((grams >> np.uint64(8)).tolist()))  # no shard is in two runs
    assert not list(lm._runs(grams[:0], n[:0], 1))


def test_lm_packs_grams():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    n = rng.integers(0, 1 << 40, len(keys))
    got = lm._unpacked(lm._packed(keys, n))
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], n)
    marks = [0, 0, 1, 1, 1, 4, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(m, pa.int32())], names=["bucket"]) for m in ([], marks[:3], marks[3:4], marks[4:])]
    assert [t["bucket"].to_pylist() for t in lm._buckets(iter(batches))] == [[0, 0], [1, 1, 1], [4, 4], [5]]


@pytest.mark.parametrize("depth", [6, 7])
def test_lm_pairs(depth):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << (8 * (depth + 1)) - 1, 50, dtype=np.uint64)[rng.integers(0, 50, 2000)]
    owner = rng.integers(0, 256, 2000)
    got = zip(*(x.tolist() for x in lm._pairs(keys, owner, depth)), strict=True)
    assert {(k, o): n for k, o, n in got} == collections.Counter(zip(keys.tolist(), owner.tolist(), strict=True))


def test_suffixes_leave_no_texts_in_shuffle_files(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(33, 127, 20_000))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held() -> dict:
        found = files.getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before = held()
    out = suffixes.deduplicate(docs)  # its first two parts are worked out and written here
    left = sum(n for name, n in held().items() if name not in before)
    assert left < sum(map(len, texts)) // 4 and out.count() == 200


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads /proc")
def test_score_starts_its_tasks_without_what_earlier_ones_left(spark):
    def left(batches):
        """MB that a worker has too much after arrays of an earlier task, before and after a task of the model starts."""
        import numpy as np
        import pyarrow as pa

        mb = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
        first = mb()
        np.ones(3 << 20)  # freed: from here on the C library keeps what is smaller
        held = [(np.ones(1 << 17), np.ones(1 << 15)) for _ in range(200)]
        pins = [h[1] for h in held]  # 52 MB between 210 MB that go
        del held
        kept = mb() - first
        lm._lean()
        yield pa.RecordBatch.from_pydict({"kept": [kept], "left": [mb() - first + 0 * pins[0][0]]})
        for _ in batches:
            pass

    found = spark.range(1).coalesce(1).mapInArrow(left, "kept double, left double").first()
    assert found.left < 90 and found.left <= found.kept + 1
