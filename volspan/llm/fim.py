"""Fill-in-the-middle: documents as prefix, suffix and middle, by rotations in place.

Spark draws the form and the two cuts of each row from a hash of its id. A worker copies the
text once into a bytearray, scans for the bytes at which the cuts lie, and sets a mark
before each part: `<P>`prefix`<M>`middle`<S>`suffix. Two neighbouring segments change places
by three reversals, within the buffer: middle and suffix for the form `psm`, the first two parts
and suffix for `spm`. `restore` finds the marks, turns the same rotation back, and deletes
the marks.

A text that holds a mark stays `plain`, so each mark occurs once in the other outputs: a mark
begins with `<` and ends with `>`, so none arises across the end of a part.

Defined results: a null text is an empty one, and an empty text is plain; a null id is hashed as an
empty string; rows are judged one by one, so repeated rows give equal results, and an empty
table gives no rows. Cuts of a very long text are found in pieces of `PIECE` bytes, and reversals
swap pieces of it: beside the row itself, memory stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from volspan.llm.arrowmap import quoted, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PIECE = 64 << 10


def byte_at(raw: np.ndarray, chars: int) -> int:
    """The byte at which the code point number `chars` begins; the end behind the last one."""
    passed = 0
    for start in range(0, len(raw), PIECE):
        leads = (raw[start : start + PIECE] & 0xC0) != 0x80
        here = int(np.count_nonzero(leads))
        if passed + here > chars:
            return start + int(np.flatnonzero(leads)[chars - passed])
        passed += here
    return len(raw)


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    while hi - lo > 1:
        n = min(PIECE, (hi - lo) // 2)
        held = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = held[::-1]
        lo, hi = lo + n, hi - n


def rotate(buffer: bytearray, lo: int, middle: int, hi: int) -> None:
    """The segments [lo, middle) and [middle, hi) change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, lo, middle)
    reverse(view, middle, hi)
    reverse(view, lo, hi)


def arranged(text: bytes, form: str, prefix_chars: int, middle_chars: int) -> bytes:
    if form == "plain":
        return text
    raw = np.frombuffer(text, np.uint8)
    first = byte_at(raw, prefix_chars)
    second = first + byte_at(raw[first:], middle_chars)
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    first, second = first + MARK, second + 2 * MARK
    rotate(buffer, first if form == "psm" else 0, second, len(buffer))
    return bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":  # <P>prefix | <S>suffix | <M>middle
        suffix, middle = buffer.find(SUFFIX), buffer.find(MIDDLE)
        rotate(buffer, suffix, middle, len(buffer))
        first, second = suffix, suffix + len(buffer) - middle
    else:  # <S>suffix | <P>prefix<M>middle
        prefix, middle = buffer.find(PREFIX), buffer.find(MIDDLE)
        rotate(buffer, 0, prefix, len(buffer))
        first, second = middle - prefix, len(buffer) - prefix
    del buffer[second : second + MARK], buffer[first : first + MARK], buffer[:MARK]
    return bytes(buffer)


def hash_group(digest: Column, i: int) -> Column:
    """Group `i` of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _map_texts(source: DataFrame, made, out: str, kept: Sequence[str]) -> DataFrame:
    """`kept` columns, then a string column `out`; `made` gets a text's bytes and its row of the columns behind them."""
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, n):
                    texts = part.column(n).cast(pa.binary()).to_pylist()
                    rows = zip(texts, *[c.to_pylist() for c in part.columns[n + 1 :]], strict=True)
                    result = pa.array([made(*row) for row in rows], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], result], names=[*kept, out])
        finally:
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, StructType([*source.schema.fields[:n], StructField(out, StringType())]))


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "fim",
    keep: Sequence[str] | None = None,
    seed: str = "1",
    percent: int = 90,
    spm_percent: int = 20,
) -> DataFrame:
    """`keep` columns (default: all) and a struct `out`: `n` (code points), `form` (plain, psm or spm),
    `prefix_chars` and `middle_chars` (null if plain), `output`. As with `withColumn`, `out` replaces
    a column of the same name.

    `percent` of the rows are rearranged, and `spm_percent` of those begin with the suffix.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))), 256)
    source = df.select(*[F.col(quoted(c)).alias(f"kept {i}") for i, c in enumerate(kept)], text.alias("text to cut"), digest.alias("digest of id"))
    n = F.length("text to cut").cast("long")
    h1, h2, h3, h4 = (hash_group(F.col("digest of id"), i) for i in range(4))
    holds = F.contains("text to cut", F.lit("<P>")) | F.contains("text to cut", F.lit("<S>")) | F.contains("text to cut", F.lit("<M>"))
    form = F.when((n == 0) | holds | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    first, second = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    drawn = source.select("*", n.alias("n"), form.alias("form")).withColumns({"prefix_chars": F.when(F.col("form") != "plain", first), "middle_chars": F.when(F.col("form") != "plain", second - first)})
    names, facts = [f"kept {i}" for i in range(len(kept))], ["n", "form", "prefix_chars", "middle_chars"]
    made = _map_texts(drawn.select(*names, *facts, "text to cut", "form", "prefix_chars", "middle_chars"), arranged, "output", [*names, *facts])
    return made.select(*[F.col(k).alias(c) for k, c in zip(names, kept, strict=True)], F.struct(*facts, "output").alias(out))


def restore(df: DataFrame, output: str = "fim.output", form: str = "fim.form", out: str = "restored") -> DataFrame:
    """All columns and `out`, the exact text, made from an output and its form alone."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    source = df.select(*[F.col(quoted(c)).alias(f"kept {i}") for i, c in enumerate(kept)], F.col(output).alias("text to restore"), F.col(form).alias("form of text"))
    back = _map_texts(source, lambda text, form: None if text is None else restored(text, form), "restored text", [f"kept {i}" for i in range(len(kept))])
    return back.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(kept)], F.col("restored text").alias(out))
