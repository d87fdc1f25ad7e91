"""Which shots count, and why others do not: by samples of a camera cube, by samples of an image, by their faces.

A shot's returns are scanned in order. A bad return makes the shot invalid and ends the scan: the returns before it keep their
values, it and those behind have none.

Defined results: a sample that is null lies outside; a shot without returns does not appear; equal orders of returns are
one place, bad if any of them is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenite.operators import tracks

MOST_RETURNS = 5
#: The detectors that an image's shot needs.
NEEDED = (1, 2, 3)


def first_bad(bad: Column, order: str) -> Column:
    return F.min(F.when(F.coalesce(bad, F.lit(True)), F.col(order)))


def kept_values(samples: DataFrame, shots: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], scanned: Column | None = None) -> DataFrame:
    """The rows of ``samples`` with ``valid``; ``values`` are null from the shot's first bad return on, or where it was not scanned."""
    rows = samples.join(shots.select(*keys, "first_bad", "valid", *(["scanned"] if scanned is not None else [])), list(keys))
    ok = F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad"))
    ok = ok if scanned is None else ok & F.col("scanned")
    return rows.select(*(F.when(ok, F.col(c)).alias(c) if c in values else F.col(c) for c in samples.columns), "valid")


def cube_shots(samples: DataFrame, keys: Sequence[str], order: str, value: str, least: Column) -> DataFrame:
    """(keys, first_bad, valid): a return is bad outside the cube, or at or below its ``least`` value."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) <= least)
    return samples.groupBy(*keys).agg(first_bad(bad, order).alias("first_bad")).withColumn("valid", F.col("first_bad").isNull())


def image_shots(
    samples: DataFrame, track: Sequence[str], shot: str, order: str, detector: str, value: str, was: str | None = None, parts: int | None = None
) -> DataFrame:
    """(track, shot, n_returns, first_bad, scanned, valid, cause) of shots under an image; tracks are dealt into ``parts``, where given.

    A shot of more than ``MOST_RETURNS`` is invalid and ends its track's scan: shots behind it stay as they were
    (``was``, a column of ``samples`` that a shot's returns share; null: unknown). A return is bad outside the image or at 0. Detectors 1, 2 and 3 must be there.
    """
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) == 0)
    has = [F.bool_or(F.coalesce(F.col(detector) == k, F.lit(False))) for k in NEEDED]
    before = F.max(was) if was else F.lit(None).cast("boolean")
    rows = samples.groupBy(*track, shot).agg(
        F.count("*").alias("n_returns"), first_bad(bad, order).alias("first_bad"), (has[0] & has[1] & has[2]).alias("_has"), before.alias("_was")
    )
    if parts:
        rows = rows.repartition(parts, *track)
    many = F.col("n_returns") > MOST_RETURNS
    earlier = W.partitionBy(*track).orderBy(shot).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_ended", F.coalesce(F.bool_or(many).over(earlier), F.lit(False)))
    cause = F.when(F.col("_ended"), "not scanned").when(many, "many returns").when(F.col("first_bad").isNotNull(), "outside or zero").when(~F.col("_has"), "no detector").otherwise("")
    scanned = ~F.col("_ended") & ~many
    rows = rows.withColumn("cause", cause).withColumn("scanned", scanned)
    valid = F.when(F.col("_ended"), F.col("_was")).otherwise(F.col("cause") == "")
    return rows.select(*track, shot, "n_returns", F.when(scanned, F.col("first_bad")).alias("first_bad"), "scanned", valid.alias("valid"), "cause")


def reflectance_shots(returns: DataFrame, shot: Sequence[str], detector: str, p: Sequence[str], light: Sequence[float], camera: Sequence[float]) -> DataFrame:
    """(shot, n_returns, reflectance, valid, cause): ``ring_reflectance`` with the cause of a -1."""
    seen = returns.groupBy(*shot).agg(F.bool_or(F.coalesce(F.col(detector) == 1, F.lit(False))).alias("_centre"))
    rows = tracks.ring_reflectance(returns, shot, detector, p, light, camera).join(seen, list(shot))
    cause = F.when(F.col("n_returns") > MOST_RETURNS, "many returns").when(~F.col("_centre"), "no centre").when(F.col("reflectance") < 0, "no triangle").otherwise("")
    return rows.withColumn("cause", cause).select(*shot, "n_returns", "reflectance", (F.col("cause") == "").alias("valid"), "cause")
