"""Quality rules: counts of words, symbols and repeats, and compression bands.

The bands compare the zstandard ratio (compressed bytes / bytes) of the whole
document, and of its fixed chunks, with limits that depend on the length in bytes:
below a band the text repeats itself, above it nothing like prose is left to
compress. `fit_bands` takes the limits of each length class from texts labelled good.

Defined results: null and empty texts have no words and fail the base rule (fewer than
`min_words` words); repeated rows get equal results; very long texts are compressed
whole, and chunk by chunk; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from volspan.llm import wordhash
from volspan.llm.arrowmap import append_struct, quoted, slices

#: (bytes up to, lowest ratio, highest ratio) for whole documents; None: any length. These hold where
#: no labelled rows fit a band: wide enough for prose of any script.
DOCUMENT_BANDS = ((100, 0.30, 1.20), (200, 0.35, 1.00), (400, 0.35, 0.90), (800, 0.30, 0.80), (1_600, 0.25, 0.72), (6_400, 0.22, 0.66), (None, 0.20, 0.62))
CHUNK_BYTES = 2048
#: The same for chunks; a document of two chunks or more is rejected when more than this share of them lies outside.
CHUNK_BANDS = ((None, 0.25, 0.64),)
CHUNK_SHARE = 0.25
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
#: Rows that a band needs at least.
FIT_LEAST = 30

RESULT = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("ratio", DoubleType()), StructField("chunks_outside", DoubleType()), StructField("reason", StringType())]
)


def band(size: int, bands: Sequence[tuple[int | None, float, float]]) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if most is None or size <= most)


def repeat_words(words: np.ndarray, window: int = 8) -> int:
    """Words that lie in a window of words found twice or more."""
    if len(words) <= window:
        return 0
    grams = wordhash.windows(words, window)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def chunk_ratios(raw: bytes, chunk_bytes: int, press) -> list[tuple[int, float]]:
    """Size and ratio of the fixed chunks; a last one under half the size belongs to the one before."""
    cut = [raw[j : j + chunk_bytes] for j in range(0, len(raw), chunk_bytes)]
    if len(cut) > 1 and len(cut[-1]) < chunk_bytes // 2:
        cut[-2:] = [cut[-2] + cut[-1]]
    return [(len(x), len(press(x)) / len(x)) for x in cut]


def length_class(size: int) -> int:
    """Lengths from 2 ** (c / 2) bytes up to the next such step are of class c."""
    return max(0, math.floor(2 * math.log2(size))) if size else 0


def fit_bands(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    good_col: str = "quality",
    chunk_bytes: int = CHUNK_BYTES,
    min_words: int = 20,
) -> tuple[tuple, tuple]:
    """Document and chunk bands from all texts labelled good.

    A band reaches from the 0.1 % to the 99.9 % quantile of the ratios of its length class, widened by a
    share of 0.02 + 0.5 / sqrt(rows): few rows prove little. A class of fewer than `FIT_LEAST` rows keeps
    its default band. All texts are compressed where they lie, and only their ratios meet the labels: no
    text is shuffled, and no list of ids is held whole. At most a few dozen quantiles reach the driver.
    """
    good = labels.where(F.col(quoted(good_col)) == 1).select(F.col(quoted(label_id)).alias("good id")).where("`good id` is not null").distinct()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where("id is not null")

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part in slices(batch, 1):
                at, kinds, ratios = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = (text or "").encode()
                    if len(raw.split(None, min_words)) < min_words:
                        continue
                    kinds.append(length_class(len(raw)))
                    ratios.append(len(press(raw)) / len(raw))
                    chunks = chunk_ratios(raw, chunk_bytes, press)
                    if len(chunks) > 1:
                        kinds += [-1] * len(chunks)
                        ratios += [r for _, r in chunks]
                    at += [i] * (len(kinds) - len(at))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.int64()), pa.array(ratios, pa.float64())], names=["id", "kind", "ratio"])

    # four digits: an exact quantile of a few thousand distinct values, however long the texts are
    q = F.percentile(F.round("ratio", 4), F.array(F.lit(0.001), F.lit(0.999)))
    measured = rows.mapInArrow(run, StructType([rows.schema["id"], StructField("kind", LongType()), StructField("ratio", DoubleType())]))
    measured = measured.join(good, measured.id == F.col("good id"), "left_semi")
    found = {r.kind: (r.n, *r.q) for r in measured.groupBy("kind").agg(F.count("*").alias("n"), q.alias("q")).where(F.col("n") >= FIT_LEAST).collect()}

    def widened(n: int, low: float, high: float) -> tuple[float, float]:
        margin = 0.02 + 0.5 / math.sqrt(n)
        return low * (1 - margin), high * (1 + margin)

    bands = []
    for c in range(2 * 40):  # up to a terabyte, then whatever is longer
        upto = math.ceil(2 ** ((c + 1) / 2)) - 1
        bands.append((upto, *(widened(*found[c]) if c in found else band(upto, DOCUMENT_BANDS))))
    chunks = ((None, *widened(*found[-1])),) if -1 in found else CHUNK_BANDS
    return (*bands, (None, *DOCUMENT_BANDS[-1][1:])), chunks


def quality_rules(
    df: DataFrame,
    text_col: str = "text",
    out: str = "quality",
    keep: Sequence[str] | None = None,
    min_words: int = 20,
    repeat_percent: int = 30,
    document_bands: Sequence[tuple[int | None, float, float]] = DOCUMENT_BANDS,
    chunk_bands: Sequence[tuple[int | None, float, float]] = CHUNK_BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_share: float = CHUNK_SHARE,
) -> DataFrame:
    """Append a struct with the counts, the ratios, `base_failed`, `kept` and the first `reason` against."""

    def run(texts: pa.Array) -> list[pa.Array]:
        words, at = wordhash.words_of(texts, fold=False)
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = []
        for i, text in enumerate(texts.to_pylist()):
            raw = (text or "").encode()
            mine = words[at[i] : at[i + 1]]
            n, repeats = len(mine), repeat_words(mine)
            chars = len(text or "") - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
            failed = n < min_words or 100 * repeats > repeat_percent * n
            ratio = len(press(raw)) / len(raw) if raw else None
            chunks = chunk_ratios(raw, chunk_bytes, press)
            limits = [band(size, chunk_bands) for size, _ in chunks]
            share = sum(not low <= r <= high for (low, high), (_, r) in zip(limits, chunks, strict=True)) / len(chunks) if len(chunks) > 1 else None
            reason = "too few words" if n < min_words else "repeated windows" if failed else None
            if reason is None and ratio is not None:
                low, high = band(len(raw), document_bands)
                reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks outside" if share is not None and share > chunk_share else None
            rows.append((n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeats, failed, reason is None, ratio, share, reason))
        return list(zip(*rows, strict=True)) if rows else [[] for _ in RESULT]

    return append_struct(df, text_col, out, RESULT, run, keep)
