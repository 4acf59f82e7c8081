"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_letter(text: str) -> bool:
    """A letter has a category of letters: neither digits nor numbers such as a half."""
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, sample_rows: int = 160, dictionary_bytes: int = 110_000, piece_chars: int = 600, windows: int = 4) -> dict[str, bytes]:
    """A raw-content dictionary for each lang of the labelled rows (doc_id, text, lang).

    Bounded sample: texts are dealt by hash to sample_rows slots a language, and each slot gives the text with the
    smallest hash: `windows` pieces of it in lower case, piece_chars characters in all, one from each equal section of the
    whole text, at a place that the hash tells. Repeated texts count once; a text without a letter is left out. Where all
    pieces are more than dictionary_bytes, each is cut to its share, so that every slot stays.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    section, width = F.floor(F.length("text") / windows), piece_chars // windows
    places = [(section * k + F.pmod(F.xxhash64("text", F.lit(k)), section - width + 1) + 1).cast("int") for k in range(windows)]
    piece = F.when(F.length("text") <= piece_chars, F.col("text")).otherwise(F.concat_ws("\n", *[F.substring("text", at, F.lit(width)) for at in places]))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.lower(piece).alias("piece"))
    # a bounded buffer per language and task, merged: no group is gathered whole
    kept = rows.groupBy("lang", F.pmod("h", F.lit(sample_rows)).alias("slot")).agg(F.min(F.struct("h", "piece")).alias("x"))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in kept.select("lang", "x.h", "x.piece").collect():
        found.setdefault(r["lang"], []).append((r["h"], r["piece"].encode()))
    out = {}
    for lang, pieces in sorted(found.items()):
        size = sum(len(p) + 1 for _, p in pieces)
        share = min(1.0, dictionary_bytes / size)
        out[lang] = b"\n".join(p[: int((len(p) + 1) * share)] for _, p in sorted(pieces))
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: dict[str, Column] | None = None, level: int = 6, margin: float = 0.01) -> DataFrame:
    """The language whose dictionary lets the whole text, in lower case, compress best.

    Returns doc_id, lang_pred, score, accepted and the columns of keep. score maps the relative gap between the two
    smallest sizes into 0..1 (see _score). accepted is false where the margin between the two
    smallest sizes is below `margin` of the larger: the answer is then only the best guess.

    Null texts and texts without any letter are 'und' with score 0, not accepted. Ties go to the first language by code
    point. With one dictionary its language has no rival: score 1. With none every text is 'und'. Texts of any length
    are compressed whole. Repeated rows repeat. Other columns are ignored.
    """
    keep = keep or {}
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            langs, scores, sure = [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                if not names or not text or not has_letter(text):
                    langs.append("und"), scores.append(0.0), sure.append(False)
                    continue
                raw = text.lower().encode()
                sizes = [len(p.compress(raw)) for p in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=None)
                gap = 1.0 if second is None else (second - sizes[best]) / second
                langs.append(names[best]), scores.append(_score(gap)), sure.append(gap >= margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], names=[c.name for c in out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in keep.items()])
    from pyspark.sql import types as T

    out = T.StructType([rows.schema[0], *rows.schema[2:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(run, out)


def _score(gap: float) -> float:
    """A relative gap between sizes as 0..1; a tenth gives 0.86."""
    return 1.0 - math.exp(-20.0 * gap)
