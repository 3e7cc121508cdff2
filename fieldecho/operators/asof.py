"""As-of joins as point-in-cell lookups.

Every reading owns the stretch of time for which it is the answer: backward, until
the next reading; nearest, up to the midpoints around it. The lookup is then the
bucketed equi join of ``stab_join``: the large side is neither sorted nor windowed,
may be broadcast against when the readings are few, and is split by AQE when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import DAY, HOUR
from .intervals import stab_join
from .running import with_neighbours


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str] = (),
              direction: str = "backward", tolerance: int | None = None, width: int = HOUR,
              right_width: int = 30 * DAY, span: tuple | None = None) -> DataFrame:
    """Left as-of join on BIGINT microseconds; readings must be unique per (by, time).

    ``nearest`` gives a tie to the earlier reading. Readings farther than
    ``tolerance`` (inclusive) are left null. The matched reading's time is kept.
    """
    by = list(by)
    if direction not in ("backward", "nearest"):
        raise ValueError(f"direction must be 'backward' or 'nearest', got {direction!r}")
    t = F.col(right_time)
    cells = right.where(t.isNotNull())
    nearest = direction == "nearest"
    cells = with_neighbours(cells, by, right_time, right_width, prev="__prev" if nearest else None, next="__next")
    if not nearest:
        cells = cells.withColumn("__lo", t).withColumn("__hi", F.col("__next"))
        if tolerance is not None:
            cells = cells.withColumn("__hi", F.least(F.coalesce("__hi", t + tolerance + 1), t + tolerance + 1))
    else:
        # first instant nearer to this reading than to the one before: floor(mid) + 1
        mid = lambda a, b: F.expr(f"({a} + {b} - pmod({a} + {b}, 2)) div 2")
        cells = (cells.withColumn("__lo", mid("__prev", f"`{right_time}`") + 1)
                 .withColumn("__hi", mid(f"`{right_time}`", "__next") + 1))
        if tolerance is not None:
            cells = (cells.withColumn("__lo", F.greatest(F.coalesce("__lo", t - tolerance), t - tolerance))
                     .withColumn("__hi", F.least(F.coalesce("__hi", t + tolerance + 1), t + tolerance + 1)))
    cells = cells.drop("__next", "__prev")
    unbounded = tolerance is None  # a tolerance bounds every cell
    return stab_join(left, cells, by, left_time, "__lo", "__hi", width, "left",
                     open_ended=unbounded, span=span).drop("__lo", "__hi")
