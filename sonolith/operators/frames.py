"""Framed features of signals (track_id, i, v) as relational operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def framed(signal: DataFrame, size: int) -> DataFrame:
    """signal with fr, the frame of `size` samples, and n, the place in it; no overlap, the last may be short."""
    return signal.withColumns({"fr": F.floor(F.col("i") / size), "n": F.col("i") % size})


def frame_rms(signal: DataFrame, size: int) -> DataFrame:
    return framed(signal, size).groupBy("track_id", "fr").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def zero_crossings(signal: DataFrame, size: int) -> DataFrame:
    """Share of sign changes in each frame; the first sample of a frame counts against the one before it, and values
    of at most 1e-10 count as positive zero."""
    clean = F.when(F.abs("v") <= 1e-10, 0.0).otherwise(F.col("v"))
    w = W.partitionBy("track_id").orderBy("i")
    flip = (F.col("s") != F.lag("s", 1).over(w)).cast("int")
    signs = signal.withColumn("s", (clean < 0).cast("int")).withColumn("flip", F.coalesce(flip, F.lit(0)))
    return framed(signs, size).groupBy("track_id", "fr").agg(F.avg("flip").alias("zcr"))


def smooth3(x: Column, w) -> Column:
    """Mean of three with replicated edges."""
    return (F.coalesce(F.lag(x).over(w), x) + x + F.coalesce(F.lead(x).over(w), x)) / 3.0


def to_db(amplitude: Column, by, amin: float = 1e-5, top_db: float = 80.0) -> Column:
    """Decibels against the maximum over `by`, with a floor of top_db below it."""
    ref = F.greatest(F.lit(amin), F.max(amplitude).over(by))
    db = 20.0 * F.log10(F.greatest(F.lit(amin), amplitude)) - 20.0 * F.log10(ref)
    return F.greatest(db, F.max(db).over(by) - top_db)


def dft_frames(signal: DataFrame, n: int) -> DataFrame:
    """track_id, fr, k, mag: DFT magnitudes of full frames of n samples, by sums against a table of n * (n/2 + 1)
    cosines and sines."""
    spark = signal.sparkSession
    waves = [(j, k, math.cos(2 * math.pi * j * k / n), math.sin(2 * math.pi * j * k / n)) for k in range(n // 2 + 1) for j in range(n)]
    table = spark.createDataFrame(waves, "n long, k int, c double, s double")
    parts = framed(signal, n).join(F.broadcast(table), "n").groupBy("track_id", "fr", "k").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"), F.count(F.lit(1)).alias("size"))
    return parts.where(F.col("size") == n).select("track_id", "fr", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def moments(frames: DataFrame, freq: Column) -> DataFrame:
    """Centroid and bandwidth of each frame; 0 for silent ones."""
    f = frames.withColumn("f", freq)
    sums = f.groupBy("track_id", "fr").agg(F.sum("mag").alias("s0"), F.sum(F.col("mag") * F.col("f")).alias("s1"), F.collect_list(F.struct("f", "mag")).alias("bins"))
    centroid = F.when(F.col("s0") > 0, F.col("s1") / F.col("s0")).otherwise(0.0)
    spread = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["mag"] * (b["f"] - F.col("centroid")) * (b["f"] - F.col("centroid")))
    return sums.withColumn("centroid", centroid).select("track_id", "fr", "centroid", F.when(F.col("s0") > 0, F.sqrt(spread / F.col("s0"))).otherwise(0.0).alias("bandwidth"))


def rolloff(frames: DataFrame, share: float) -> DataFrame:
    """First bin at which the cumulative magnitude reaches the share of the frame's total."""
    w = W.partitionBy("track_id", "fr")
    run = F.sum("mag").over(w.orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    near = frames.withColumns({"run": run, "total": F.sum("mag").over(w)})
    return near.where(F.round("run", 9) >= F.round(F.col("total") * share, 9)).groupBy("track_id", "fr").agg(F.min("k").alias("bin"))


def flatness(frames: DataFrame, amin: float = 1e-10) -> DataFrame:
    power = F.greatest(F.lit(amin), F.col("mag") * F.col("mag"))
    return frames.groupBy("track_id", "fr").agg((F.exp(F.avg(F.log(power))) / F.avg(power)).alias("flatness"))


def band_energy(frames: DataFrame, edges: list[int], names: list[str], top_db: float = 80.0) -> DataFrame:
    """track_id, fr, band, db: power of each band of bins [edge, next), the last one closed, in decibels against the
    track's largest, floored, and smoothed over three frames. Silent tracks are at the floor."""
    last = len(names) - 1
    band = F.lit(None).cast("int")
    for b in range(last, -1, -1):
        inside = (F.col("k") >= edges[b]) & ((F.col("k") <= edges[b + 1]) if b == last else (F.col("k") < edges[b + 1]))
        band = F.when(inside, b).otherwise(band)
    power = frames.withColumn("band", band).where("band IS NOT NULL").groupBy("track_id", "fr", "band").agg(F.sum(F.col("mag") * F.col("mag")).alias("power"))
    track = W.partitionBy("track_id")
    most = F.max("power").over(track)
    db = F.greatest(F.lit(-top_db), 10.0 * F.log10(F.greatest(F.lit(1e-10), F.col("power"))) - 10.0 * F.log10(most))
    level = power.withColumn("level", F.when(most <= 1e-10, -top_db).otherwise(db))
    w = W.partitionBy("track_id", "band").orderBy("fr")
    return level.select("track_id", "fr", "band", F.element_at(F.array(*map(F.lit, names)), F.col("band") + 1).alias("name"), smooth3(F.col("level"), w).alias("db"))


def onset_flux(bands: DataFrame) -> DataFrame:
    """Mean over bands of the rise in decibels against the frame before."""
    w = W.partitionBy("track_id", "band").orderBy("fr")
    rise = bands.withColumn("rise", F.greatest(F.lit(0.0), F.coalesce(F.col("db") - F.lag("db").over(w), F.lit(0.0))))
    return rise.groupBy("track_id", "fr").agg(F.avg("rise").alias("onset"))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """track_id, lag, ac: autocorrelation of (track_id, i, x), divided by that at lag 0. Each value meets the max_lag
    values after it by an equi-join on i."""
    ahead = series.select("track_id", F.col("x").alias("y"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_lag)), lambda lag: F.struct(lag.alias("lag"), (F.col("i") - lag).alias("i")))).alias("t")).select("track_id", "y", "t.lag", "t.i")
    sums = series.join(ahead, ["track_id", "i"]).groupBy("track_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(W.partitionBy("track_id"))
    return sums.select("track_id", "lag", F.when(zero > 0, F.col("s") / zero).otherwise(0.0).alias("ac"))


def local_peaks(series: DataFrame) -> DataFrame:
    """Rows above both neighbours."""
    w = W.partitionBy("track_id").orderBy("i")
    return series.withColumns({"p": F.lag("x").over(w), "q": F.lead("x").over(w)}).where("p < x AND x > q").drop("p", "q")


def block_mean(series: DataFrame, factor: int) -> DataFrame:
    """Means of full blocks; a short last block is dropped, series of up to `factor` values stay as they are."""
    n = F.count(F.lit(1)).over(W.partitionBy("track_id"))
    known = series.withColumn("len", n)
    blocks = known.where(F.col("len") > factor).groupBy("track_id", F.floor(F.col("i") / factor).alias("b")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("c")).where(F.col("c") == factor).drop("c")
    return blocks.unionByName(known.where(F.col("len") <= factor).select("track_id", F.col("i").alias("b"), "x"))


def as_of(left: DataFrame, right: DataFrame, values: list[str], by: str = "track_id", on: str = "t") -> DataFrame:
    """left with the values of the last row of right at or before its time: a union, and a window that carries the
    last value on; one shuffle, no range join."""
    carry = F.struct(*values)
    both = left.withColumns({"__v": F.lit(None).cast(right.select(carry).schema[0].dataType), "__side": F.lit(1)}).unionByName(
        right.select(by, on, carry.alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = W.partitionBy(by).orderBy(on, "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def align(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """frames (track_id, fr, x) cut or edge-padded to n frames (track_id, n)."""
    grid = lengths.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("fr"))
    w = W.partitionBy("track_id").orderBy("fr").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(frames, ["track_id", "fr"], "left").select("track_id", "fr", F.last("x", ignorenulls=True).over(w).alias("x"))
