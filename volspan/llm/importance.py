"""Quality by importance resampling over hashed n-grams.

Words and word pairs are hashed into `buckets`. Two generative models count them:
the raw model over all documents, the target model over documents labelled good. A
document's log weight is the sum over its n-grams of log(target / raw): the log of the
ratio of its probabilities under both. Documents are sampled without replacement by
Gumbel top-k: the `keep_share` of all documents with the largest log weight + Gumbel
noise. The noise comes from a hash of the id (of the text where the id is null), so that a
task that runs again draws the same.

Weights of long texts are far apart, so noise decides among short and borderline ones
only; `length_power` p divides the sum by n ** p for a softer draw (1: the mean).

The k-th largest key is found exactly by counting rounds over narrowing intervals; nothing is sorted
or collected whole.

Defined results: null and empty texts have no n-grams and log weight 0 (neither
model prefers them); repeated rows get equal keys; rows tied at the k-th key are all
kept; an empty table gives an empty result; without a labelled good document every
log weight is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from volspan.llm import wordhash
from volspan.llm.arrowmap import append_struct, quoted, slices
from volspan.llm.shared import stored

BUCKETS = 10_000
#: Bound on the expected number of labelled good documents that fit the target model.
TARGET_ROWS = 50_000


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the index of the text of each."""
    words, at = wordhash.words_of(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    with np.errstate(over="ignore"):
        pairs = wordhash.mix(words[:-1] * np.uint64(3) + words[1:])[row[:-1] == row[1:]]
    both = np.concatenate([words, pairs]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([row, row[:-1][row[:-1] == row[1:]]])


def bounded_labels(labels: DataFrame, id_col: str, good: str, most: int) -> DataFrame:
    """Ids of good labels, thinned by a hash of the id to about `most` rows when there are more."""
    ids = labels.where(F.col(quoted(good)) == 1).select(F.col(quoted(id_col)).alias("good id")).where("`good id` is not null").distinct()
    share = min(1.0, most / max(1, ids.count()))
    return ids if share == 1.0 else ids.where(F.pmod(F.xxhash64("good id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def model_counts(docs: DataFrame, good_ids: DataFrame, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """Counts of each bucket in all documents and in the good ones: 2 x buckets numbers."""
    marked = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    marked = marked.join(F.broadcast(good_ids), marked.id == F.col("good id"), "left")
    marked = marked.select("text", F.col("good id").isNotNull().alias("good"))

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                bucket, row = features(part.column(0), buckets)
                good = np.asarray(part.column(1).to_pylist(), bool)[row]
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[good], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "good"])

    sums = marked.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    out = np.zeros((2, buckets), np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[:, r.bucket] = r.raw, r.good
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, both smoothed; zeros without a target document."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    smooth = (counts + 1.0) / (counts.sum(axis=1, keepdims=True) + counts.shape[1])
    return np.log(smooth[1] / smooth[0])


def gumbel(id_col: str, text_col: str, seed: int):
    """Standard Gumbel noise from a hash of the id, or else of the text."""
    own = F.coalesce(F.col(quoted(id_col)).cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(quoted(text_col)).cast("string"))))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), own), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


#: Parts into which a round cuts the interval that holds the wanted key: so many counts reach the driver at most.
PARTS = 4096


def kth_largest(keys: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest of a column of finite doubles, exactly; the smallest for a larger k.

    A round counts the keys of an interval by parts, with the least and largest key of each; the part that holds the wanted
    key is the next interval, until it holds a single value.
    """
    n, low, high = keys.agg(F.count(key), F.min(key), F.max(key)).first()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while low < high:
        width = high / 2 - low / 2
        place = F.floor((F.col(key) / 2 - low / 2) / width * PARTS) if width > 0 else F.when(F.col(key) > low, PARTS - 1).otherwise(0)
        inside = keys.where(F.col(key).between(low, high)).groupBy(F.least(place, F.lit(PARTS - 1)).alias("part"))
        for part in sorted(inside.agg(F.count("*").alias("held"), F.min(key).alias("least"), F.max(key).alias("most")).collect(), reverse=True):
            if k <= part.held:
                low, high = part.least, part.most
                break
            k -= part.held
    return low


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    good_col: str = "quality",
    keep_share: float = 0.9,
    length_power: float = 0.0,
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
    seed: int = 7,
) -> DataFrame:
    """Per document: `id_col`, `n_grams`, `log_weight`, `gumbel_key` and `kept`."""
    weights = log_ratio(model_counts(docs, bounded_labels(labels, label_id, good_col, target_rows), id_col, text_col, buckets))

    def score(texts: pa.Array) -> list[np.ndarray]:
        bucket, row = features(texts, buckets)
        n = np.bincount(row, minlength=len(texts))
        total = np.bincount(row, weights[bucket], minlength=len(texts))
        return [n.astype(np.int64), total / np.maximum(n, 1) ** length_power]

    dtype = StructType([StructField("n_grams", LongType()), StructField("log_weight", DoubleType())])
    noisy = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("text to weigh"), gumbel(id_col, text_col, seed).alias("noise"))
    scored = append_struct(noisy, "text to weigh", "importance result", dtype, score, keep=[id_col, "noise"])
    key = F.col("`importance result`.log_weight") + F.col("noise")
    scored = stored(scored.select(quoted(id_col), "`importance result`.*", key.alias("gumbel_key")), "importance")
    least = kth_largest(scored.select("gumbel_key"), "gumbel_key", round(keep_share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= least)
