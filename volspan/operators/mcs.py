"""Model Confidence Set by block bootstrap, in closed form.

The model that is dropped next is always the survivor with the largest mean loss, and a
pair's bootstrap variance does not depend on who survives. So models are ranked once,
every pair gets the level at which both still compete, and the statistics of all
levels are running maxima over pairs: no loop over eliminations.

The losses of a symbol and horizon are shuffled once, and one task turns them into all replicates'
means and the set (`mcs`); draws and pairs never become rows. `block_bootstrap` and
`bootstrap_means` give the draws and the means themselves as tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.operators.compare import GROUP, SERIES
from volspan.session import new_path

MODULUS = 1 << 31
#: Rows of all series, about 100 bytes each, that are broadcast to the draws.
BROADCAST_ROWS = 500_000


def hashed_start(b: Column, j: Column, t: Column, block: int, seed: int) -> Column:
    """A start in [0, t - block] from integer arithmetic that any engine can repeat."""
    x = (b * 48271 + j * 69621 + seed * 16807 + 12345) % MODULUS
    for _ in range(3):
        x = (x * 1103515245 + 12345) % MODULUS
        x = (x + F.floor(x / 32768)) % MODULUS
    return F.floor(x * (t - block + 1) / MODULUS).cast("long")


def block_bootstrap(lengths: DataFrame, block: int = 22, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Blocks (T, b, j, start, size) of every replicate for each distinct length `T`; the last block is cut to fit."""
    spark = lengths.sparkSession
    t = lengths.select("T").distinct().where(F.col("T") >= block)
    reps = spark.range(replicates).select(F.col("id").alias("b"))
    blocks = F.ceil(F.col("T") / block)
    drawn = t.crossJoin(reps).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return drawn.select("T", "b", "j", hashed_start(F.col("b"), F.col("j"), F.col("T"), block, seed).alias("start"), F.least(F.lit(block), F.col("T") - F.col("j") * block).alias("size"))


def bootstrap_means(loss: DataFrame, block: int = 22, replicates: int = 10_000, seed: int = 42, starts: DataFrame | None = None) -> DataFrame:
    """Mean loss of every series in every replicate. `starts` takes the place of the hashed draws.

    The series are written once. Up to `BROADCAST_ROWS` of their rows go to where the draws are
    made: a replicate's blocks are then summed before anything is shuffled.
    """
    whole = Window.partitionBy(*SERIES)
    w = whole.orderBy("date")
    x = loss.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "T": F.count("*").over(whole), "sum": F.sum("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    x = x.select(*SERIES, "T", "pos", F.coalesce("sum", F.lit(0.0)).alias("before"), F.sum("loss").over(w.rowsBetween(0, block - 1)).alias("full"), "loss")
    path = new_path(loss.sparkSession, "series")
    x.write.parquet(path)
    x = loss.sparkSession.read.parquet(path)
    starts = block_bootstrap(x, block, replicates, seed) if starts is None else starts
    if x.count() <= BROADCAST_ROWS:
        x = F.broadcast(x)
    starts = starts.select("T", "b", F.col("start").alias("pos"), "size")
    sums = x.join(starts.where(F.col("size") == block), ["T", "pos"]).select(*SERIES, "T", "b", F.col("full").alias("part"))
    # the cut blocks: running sums at both ends
    ends = x.select(*SERIES, "T", (F.col("pos") + 1).alias("pos"), (F.col("before") + F.col("loss")).alias("upto"))
    first = x.join(starts.where(F.col("size") < block), ["T", "pos"]).select(*SERIES, "T", "b", "before", (F.col("pos") + F.col("size")).alias("pos"))
    last = first.join(ends, [*SERIES, "T", "pos"]).select(*SERIES, "T", "b", (F.col("upto") - F.col("before")).alias("part"))
    return sums.unionByName(last).groupBy(*SERIES, "T", "b").agg((F.sum("part") / F.first("T")).alias("boot_mean")).drop("T")


def hashed_starts(t: int, replicates: int, block: int, seed: int) -> np.ndarray:
    """The starts of `block_bootstrap` for one length, (replicate, block)."""
    x = (np.arange(replicates)[:, None] * 48271 + np.arange(-(-t // block)) * 69621 + seed * 16807 + 12345) % MODULUS
    for _ in range(3):
        x = (x * 1103515245 + 12345) % MODULUS
        x = (x + x // 32768) % MODULUS
    return x * (t - block + 1) // MODULUS


def seeded_starts(t: int, replicates: int, block: int, seed: int) -> np.ndarray:
    """The starts that numpy's legacy generator draws with this seed, replicate after replicate."""
    return np.random.RandomState(seed).randint(0, t - block + 1, size=(replicates, -(-t // block)))


DRAWS = {"hashed": hashed_starts, "seeded": seeded_starts}
#: Replicates whose blocks are summed at once.
REPLICATES_AT_ONCE = 1000


def replicate_means(loss: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Mean of one series in every replicate, from running sums at both ends of each block; the last block is cut to fit."""
    t = len(loss)
    upto = np.concatenate([[0.0], np.cumsum(loss - loss.mean())])
    size = np.full(starts.shape[1], block)
    size[-1] = t - block * (len(size) - 1)
    parts = [(upto[s + size] - upto[s]).sum(1) for s in np.split(starts, range(REPLICATES_AT_ONCE, len(starts), REPLICATES_AT_ONCE))]
    return np.concatenate(parts) / t + loss.mean()


def eliminate(means: np.ndarray, boot: np.ndarray) -> np.ndarray:
    """p-values of the levels 2, 3, ... at which the best so many models compete: `means` (rising) and `boot` (replicate, model)."""
    t_boot, t_obs = np.zeros(len(boot)), 0.0
    out = []
    for level in range(1, len(means)):
        d, mean_d = boot[:, :level] - boot[:, level : level + 1], means[:level] - means[level]
        sd = np.sqrt(np.maximum(d.var(axis=0), 1e-30))
        t_boot = np.maximum(t_boot, (np.abs(d - mean_d) / sd).max(axis=1))
        t_obs = max(t_obs, float((np.abs(mean_d) / sd).max()))
        out.append(float((t_boot >= t_obs).mean()))
    return np.array(out)


def mcs(loss: DataFrame, alpha: float = 0.10, replicates: int = 10_000, block: int = 22, seed: int = 42, draws: str = "hashed") -> DataFrame:
    """Per symbol, horizon and model: mean loss, rank, `in_mcs`, `mcs_pvalue`.

    `draws` are "hashed", which any engine can repeat, or "seeded", those of numpy's legacy generator. Null losses are
    left out; a series shorter than a block is not compared, and stays in the set.
    """
    draw = DRAWS[draws]
    rows = loss.where("loss is not null").select(*SERIES, "date", F.col("loss").cast("double").alias("loss"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in SERIES}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", mean double, rank int, in_mcs boolean, mcs_pvalue double"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("model", "ascending"), ("date", "ascending")])
        losses = group.column("loss").to_numpy()
        encoded = group.column("model").combine_chunks().dictionary_encode()
        at = np.concatenate([[0], np.flatnonzero(np.diff(encoded.indices.to_numpy())) + 1, [len(losses)]])
        names = [encoded.dictionary[encoded.indices[int(i)].as_py()].as_py() for i in at[:-1]]
        series = [losses[i:j] for i, j in zip(at, at[1:], strict=False)]
        means = np.array([x.mean() for x in series])
        order = sorted(range(len(names)), key=lambda i: names[i], reverse=True)
        order.sort(key=lambda i: means[i])
        ranks = {i: r + 1 for r, i in enumerate(order)}
        starts = {t: draw(t, replicates, block, seed) for t in {len(x) for x in series} if t >= block}
        compared = [i for i in order if len(series[i]) in starts]
        p: dict[int, float] = {}
        if len(compared) > 1:
            boot = np.column_stack([replicate_means(series[i], starts[len(series[i])], block) for i in compared])
            p = {ranks[i]: x for i, x in zip(compared[1:], eliminate(means[compared], boot), strict=True)}
        stop = max((level for level, x in p.items() if x >= alpha), default=1) if p else len(names)
        last = p.get(min((level for level in p if level >= stop), default=-1), 1.0)
        first = {c: group.column(c)[0] for c in ("symbol", "horizon")}
        kept = [ranks[i] <= stop for i in range(len(names))]
        columns = [pa.array([first[c].as_py()] * len(names), first[c].type) for c in ("symbol", "horizon")]
        columns += [pa.array(names, group.schema.field("model").type), pa.array(means), pa.array([ranks[i] for i in range(len(names))], pa.int32()), pa.array(kept)]
        columns.append(pa.array([max(last, alpha) if k else p.get(ranks[i]) for i, k in enumerate(kept)], pa.float64()))
        return pa.Table.from_arrays(columns, names=[*SERIES, "mean", "rank", "in_mcs", "mcs_pvalue"])

    return rows.groupBy(*GROUP).applyInArrow(run, schema)
