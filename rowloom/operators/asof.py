"""As-of lookups: for each point, the last start at or before it, without a range join or a single-task window.

Starts carry a number that grows with their place, so "the last one" is a running maximum. Points and starts are dealt
into spans of the place, the maximum runs inside a span, and what earlier spans have reached is added from one row a
span. Nothing is exploded, whatever lies between two starts, and points that crowd in one place are only sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(points: DataFrame, starts: DataFrame, at: str, value: str, out: str, span: Callable[[Column], Column], by: tuple[str, ...] = ()) -> DataFrame:
    """points with ``out``: the greatest ``value`` of the starts (of the same ``by``) whose ``at`` is no greater than the
    point's; null where there is none.

    Both have columns by and ``at`` (numbers of one type); value must not fall as ``at`` grows. span: from a place to the
    number of its span, not falling either; spans of some ten thousand rows are about right."""
    kind = points.schema[at].dataType
    own = points.select(*by, F.col(at).cast(kind).alias("__at"), F.lit(1).alias("__is_point"), F.lit(None).cast("long").alias("__value"), F.struct(*points.columns).alias("__row"))
    begun = starts.select(*by, F.col(at).cast(kind).alias("__at"), F.lit(0).alias("__is_point"), F.col(value).cast("long").alias("__value"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"))
    both = own.unionByName(begun).withColumn("__span", span(F.col("__at")).cast("long"))
    reached = both.groupBy(*by, "__span").agg(F.max("__value").alias("__most"))
    earlier = W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    carried = reached.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__span").alias("__of"), F.max("__most").over(earlier).alias("__before"))
    inside = W.partitionBy(*by, "__span").orderBy("__at", "__is_point").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__here", F.max("__value").over(inside)).where("__is_point = 1")
    on = F.col("__span") == F.col("__of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return found.join(carried, on).select("__row.*", F.greatest("__here", "__before").alias(out))
