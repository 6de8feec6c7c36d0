"""Sections of tracks: labels, boundaries, energies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.constants import DROP_ENERGY


def label_sections(sections: DataFrame) -> DataFrame:
    """track_id, sidx, e, label of sections (track_id, sidx, rms).

    Energies are relative to the track's largest (0 where that is at most 1e-6). The first largest section and inner
    ones of at least DROP_ENERGY are drops; the first is else an intro, the last an outro; of the others, one whose next
    is a drop and that rises is a build, one up to the median a breakdown, a rising one a build, else a breakdown."""
    w = W.partitionBy("track_id")
    o = w.orderBy("sidx")
    most = F.max("rms").over(w)
    s = sections.withColumn("e", F.when(most <= 1e-6, 0.0).otherwise(F.col("rms") / most))
    s = s.withColumns({"n": F.count(F.lit(1)).over(w), "rn": F.row_number().over(o), "med": F.percentile("e", 0.5).over(w), "peak": F.first("sidx").over(w.orderBy(F.round("e", 9).desc(), "sidx"))})
    inner = (F.col("rn") > 1) & (F.col("rn") < F.col("n"))
    s = s.withColumn("drop", (F.col("sidx") == F.col("peak")) | (inner & (F.round("e", 9) >= DROP_ENERGY)))
    e, before = F.round("e", 9), F.round(F.lag("e").over(o), 9)
    rising = e > before
    label = (
        F.when(F.col("drop"), "drop").when(F.col("rn") == 1, "intro").when(F.col("rn") == F.col("n"), "outro")
        .when(F.lead("drop").over(o) & rising, "build").when(e <= F.round("med", 9), "breakdown").when(rising, "build").otherwise("breakdown")
    )
    return s.withColumn("label", label).select("track_id", "sidx", "e", "label")


def spaced(times: Column, gap: Column) -> Column:
    """Sorted times, kept from left to right if at least gap after the last kept one: an Arrow kernel, one pass over
    each array, where a fold of array expressions would copy the result at every step."""

    def one(values: np.ndarray, least: float) -> list[float]:
        out: list[float] = []
        for t in values.tolist():
            if not out or t - out[-1] >= least:
                out.append(t)
        return out

    @F.pandas_udf("array<double>")
    def kept(rows: pd.Series, gaps: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else one(np.asarray(v), g) for v, g in zip(rows, gaps, strict=True)])

    return kept(times, gap)


def keep_boundaries(times: Column, end: Column, gap: Column | float) -> Column:
    """Sorted times, kept from left to right if at least `gap` after the last kept one; a last one less than `gap`
    before the end is replaced by the end, else the end is added."""
    kept = spaced(times, gap if isinstance(gap, Column) else F.lit(float(gap)))
    near = (F.size(kept) > 1) & (end - F.element_at(kept, -1) < gap)
    return F.when(near, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(end))).otherwise(F.concat(kept, F.array(end)))


def section_rms(signal: DataFrame, sections: DataFrame) -> DataFrame:
    """track_id, sidx, rms of sections (track_id, sidx, lo, hi) over samples lo <= i < hi: sections list the buckets of
    samples that they touch, so the interval join is an equi-join with a recheck."""
    width = 16
    touched = sections.where("hi > lo").withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    inside = signal.withColumn("b", F.floor(F.col("i") / width)).join(touched, ["track_id", "b"]).where("i >= lo AND i < hi")
    sums = inside.groupBy("track_id", "sidx").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return sections.select("track_id", "sidx").join(sums, ["track_id", "sidx"], "left").withColumn("rms", F.coalesce("rms", F.lit(0.0)))


def sections_json(sections: DataFrame) -> DataFrame:
    """track_id, sections: JSON of the sections in order (start, end to 2 places, label, energy to 3)."""
    item = F.struct(F.bround("start", 2).alias("start"), F.bround("end", 2).alias("end"), "label", F.bround("e", 3).alias("energy"))
    return sections.groupBy("track_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("sidx", item.alias("x")))), lambda s: s["x"])).alias("sections"))
