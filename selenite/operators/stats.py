"""Error statistics that merge: partial rows per source, then one final sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The edges of the error histogram.
EDGES = (0, 25, 50, 75, 100, 125, 150, 175, 200, 225, 250, 1000, 2500, 5000, 10000)


def error_statistics(errors: DataFrame, keys: Sequence[str] = (), error: str = "err", edges: Sequence[float] = EDGES) -> DataFrame:
    """Least, largest, mean, number and histogram of the errors that are not negative.

    Bin k holds errors above edge k up to edge k + 1, the last all above its edge;
    errors at or below the first edge count but fall into no bin.
    """
    e = F.col(error)
    bins = [F.count(F.when((e > a) & (e <= b), 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bins.append(F.count(F.when(e > edges[-1], 1)))
    return errors.where(e >= 0).groupBy(*keys).agg(
        F.min(e).alias("min_err"), F.max(e).alias("max_err"), F.avg(e).alias("avg_err"), F.count("*").alias("n"), F.array(*bins).alias("hist")
    )


def merge_statistics(parts: DataFrame, keys: Sequence[str] = (), n_bins: int = len(EDGES)) -> DataFrame:
    """The statistics of the union of the parts."""
    return parts.groupBy(*keys).agg(
        F.min("min_err").alias("min_err"),
        F.max("max_err").alias("max_err"),
        (F.sum(F.col("avg_err") * F.col("n")) / F.sum("n")).alias("avg_err"),
        F.sum("n").alias("n"),
        F.array(*(F.sum(F.col("hist")[k]) for k in range(n_bins))).alias("hist"),
    )


def histogram_rows(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stats.select(*keys, F.posexplode("hist").alias("bin", "n"))
