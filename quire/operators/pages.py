"""Page ranges, page filters and presets, progress totals, enabled services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import values


def parse_ranges(spec: Column) -> Column:
    """"1-3,5" to [0, 1, 2, 4]: in order, repeats kept; a range that ends early is empty."""

    def each(part: Column) -> Column:
        ends = F.split(part, "-")
        lo = F.trim(ends[0]).cast("int")
        hi = F.trim(F.try_element_at(ends, F.lit(2))).cast("int")
        none = F.array().cast("array<int>")
        return F.when(~part.contains("-"), F.array(lo - 1)).when(hi < lo, none).otherwise(F.sequence(lo - 1, F.greatest(hi, lo) - 1))

    return F.flatten(F.transform(F.split(spec, ","), each))


def select(pages: DataFrame, wanted: Sequence[int] | DataFrame | None, pageno: str = "pageno") -> DataFrame:
    """Wanted pages only; none wanted means every page. To be called before any Python stage."""
    if wanted is None or (not isinstance(wanted, DataFrame) and not len(wanted)):
        return pages
    if isinstance(wanted, DataFrame):
        return pages.join(wanted.distinct(), pageno, "left_semi")
    return pages.where(F.col(pageno).isin(*sorted(set(wanted))))


def preset(pages: DataFrame, name: str, demo: bool = False, pageno: str = "pageno") -> DataFrame:
    first = (values.DEMO_PAGE_PRESETS if demo else values.PAGE_PRESETS)[name]
    return pages if first is None else pages.where(F.col(pageno) < first)


def progress_total(wanted: Column | None, page_count: Column) -> Column:
    """Steps that a progress report counts: the wanted list as given, else all pages."""
    return page_count if wanted is None else F.when(F.size(wanted) > 0, F.size(wanted)).otherwise(page_count).cast("long")


def enabled_services(spark: SparkSession, services: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """Two services always, then the named ones in registry order; an error if none is known.

    ``services`` has columns position and name.
    """
    asked = spark.createDataFrame([(str(x).strip().lower(),) for x in enabled], "asked string").distinct()
    named = services.join(F.broadcast(asked), F.trim(F.lower("name")) == F.col("asked"), "left_semi")  # as many rows as names given
    if not named.limit(1).count():
        raise ValueError("none of the enabled services is known")
    always = spark.createDataFrame([(k - len(values.ALWAYS_ENABLED), n) for k, n in enumerate(values.ALWAYS_ENABLED)], "position int, name string")
    return always.unionByName(named.select(F.col("position").cast("int"), "name"))
