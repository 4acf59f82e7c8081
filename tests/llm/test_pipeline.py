"""Each pipeline stage, and the whole, held against a plain version."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from geocell.llm import mixing, pii, quality, tokens
from geocell.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
#: Extra columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, row string, id int, score double, host string, c0 string, evidence string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, personal data, clashing names."""
    rng = random.Random(2)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    base = [text(rng.randint(20, 60)) for _ in range(12)]
    texts = [*base, *base[:3], None, None, "", "", text(6000), "write to bo.b42@mail.example.com " + base[5], base[7] + " end"]
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s1", "s2"][k % 2], None if t is None else len(t), k, "r", None, 0.5, "h", "c", None) for k, t in enumerate(texts)]
    rows += [(None, base[2], None, None, None, None, None, 1, None, None, None, None), (None, text(30), *[None] * 10), rows[4], rows[4], tuple([None] * 12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_quality(spark, odd):
    """Against the classifier's weights and the posteriors worked out row by row."""
    got = rows_of(cp.keep_good(spark, odd, SF))
    weights = quality.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in odd.collect()]
    evidence = [min(30, max(-30, float(sum(a * b for a, b in zip([*quality.features(r[1]), 1.0], weights, strict=True))))) for r in rows]
    good = [1 / (1 + 2.718281828459045 ** -e) for e in evidence]
    s = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame([(r[3], r[2], g) for r, g in zip(rows, good, strict=True)], "host string, path string, good double")).collect()}
    want = collections.Counter()
    logit = lambda p: math.log(max(1e-6, min(1 - 1e-6, p)) / (1 - max(1e-6, min(1 - 1e-6, p))))
    for r, e, g in zip(rows, evidence, good, strict=True):
        x = s[r[3], r[2]]
        prior = (x.hs - g + x.k * x.rate) / (x.hn - 1 + x.k)
        site = (x.s - g + x.k2 * prior) / (x.n - 1 + x.k2)
        if 1 / (1 + math.exp(-(e + 0.5 * (logit(site) - logit(x.rate))))) >= 0.5:
            want[r] += 1
    assert got == want and cp.keep_good(spark, odd, SF).columns == odd.columns


def test_one_of_each(spark, odd):
    out = cp.keep_one_of_each(spark, odd, SF)
    rows = [tuple(r) for r in odd.collect()]
    left, want = list(range(len(rows))), collections.Counter()
    sets = [grams(r[1]) for r in rows]
    while left:  # grow a class from any row
        own, queue = set(), [left[0]]
        while queue:
            i = queue.pop()
            own.add(i)
            queue += [j for j in left if j not in own and j not in queue and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        left = [i for i in left if i not in own]
        want[min(((rows[i][0] is None, rows[i][0]) for i in own), key=lambda x: (x[0], x[1] or 0))[1]] += 1
    assert collections.Counter(r.doc_id for r in out.collect()) == want and not rows_of(out) - rows_of(odd) and out.columns == odd.columns


def test_masking(spark, odd):
    out = cp.mask_personal_data(spark, odd, SF)
    model = pii.learn(odd)
    want = collections.Counter()
    for r in odd.collect():
        base = pii.base_spans(r.text) if r.text else []
        text = pii.masked(r.text, base + pii.field_spans(r.text, base, model)) if base else r.text
        n = None if r.n_chars is None or text is None else len(text)
        want[tuple((r.asDict() | {"text": text, "n_chars": n}).values())] += 1
    assert rows_of(out) == want and out.columns == odd.columns
    assert pii.find(out).agg(F.sum("n_email")).first()[0] == 0


def test_mixing(spark, odd):
    out = cp.mix_sources(spark, odd, SF)
    sizes = odd.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64(*[F.col(c) for c in odd.columns]).alias("h"))
    per = collections.Counter()
    for r in mixing.mix(sizes).collect():
        per[r.doc_id, r.size] += r.copies
    size = lambda t: len((t or "").split())
    got = collections.Counter((r.doc_id, size(r.text)) for r in out.collect())
    assert got == +per and not set(rows_of(out)) - set(rows_of(odd)) and out.columns == odd.columns


def test_packing(spark, odd):
    ids = tokens.cache(*tokenizer())
    want = collections.Counter((r.doc_id, len(tokens.encode_document(r.text or "", ids)) // 4 + 1) for r in odd.collect())
    got = cp.pack(spark, odd, SF).where("start = 0").collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got) == want


def test_empty_table(spark, odd):
    empty = odd.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    """run() is its stages one after the other; labels, classes and pieces are as they should be."""
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out, kept = docs, []
    for _, stage in cp.STAGES:
        out = cp.written(stage(spark, out, SF))
        kept.append(out)
    good = {r.doc_id for r in kept[0].collect()}
    assert sum((labels[i] == 1) == (i in good) for i in labels) >= 0.97 * len(labels)
    sets = {r.doc_id: grams(r.text) for r in kept[1].collect()}
    ids = list(sets)
    assert set(ids) <= good and not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for k, i in enumerate(ids) for j in ids[:k])
    assert all(k.columns == docs.columns for k in kept[:4])
    assert collections.Counter(r.doc_id for r in kept[4].where("start = 0").collect()) == collections.Counter(r.doc_id for r in kept[3].collect())
    documents = lambda df: collections.Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert documents(cp.run(spark, SF)) == documents(kept[4])


def test_entry_has_all():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
