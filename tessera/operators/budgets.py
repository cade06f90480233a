"""Token budgets dealt out to sections and to a text's windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: the first window's part where there are two, and where there are more; fixed values
FIRST_OF_TWO, FIRST_OF_MORE = 0.6, 0.5


def window_allocation(position: Column, windows: Column, tokens: Column) -> Column:
    """Tokens of the window at ``position`` (from 0): all of them, 60 to 40, or half and a quarter each; windows after the third have one. None has less than one."""
    one = F.lit(1).cast("long")
    part = lambda share: F.greatest(one, F.floor(tokens * F.lit(share)))
    first = F.when(windows == 2, part(FIRST_OF_TWO)).otherwise(part(FIRST_OF_MORE))
    rest = F.greatest(one, tokens - first)
    middle = F.greatest(one, F.floor(rest / 2))
    return (
        F.when(windows == 1, tokens)
        .when(position == 0, first)
        .when(windows == 2, rest)
        .when(position == 1, middle)
        .when(position == 2, F.greatest(one, rest - middle))
        .otherwise(one)
        .cast("long")
    )


def truncated(text: Column, tokens: Column, marker: str = " [truncated]") -> Column:
    """At most ``tokens`` estimated tokens; cut texts end with ``marker``."""
    room = F.greatest(F.lit(0), tokens * T.CHARS_PER_TOKEN - len(marker)).cast("int")
    return F.when(T.estimated_tokens(text) <= tokens, text).otherwise(F.concat(F.regexp_replace(F.substring(text, F.lit(1), room), r"\s+$", ""), F.lit(marker)))


def capped_windows(windows: DataFrame, keys: Sequence[str], order: str, text: str, budget: Column | int) -> DataFrame:
    """Windows of a text cut to its budget: as they are where they fit together, else by ``window_allocation``; with ``allocated``, null where nothing was cut."""
    budget = (F.lit(budget) if isinstance(budget, int) else budget).cast("long")
    all_, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    sized = windows.withColumns({"__sum": F.sum(T.estimated_tokens(text)).over(all_), "__n": F.count("*").over(all_), "__at": F.row_number().over(w) - 1})
    over = F.coalesce(F.col("__sum"), F.lit(0)) > budget
    given = sized.withColumn("allocated", F.when(over, window_allocation(F.col("__at"), F.col("__n"), F.greatest(F.lit(1).cast("long"), budget))))
    return given.withColumn(text, F.when(F.col("allocated").isNull(), F.col(text)).otherwise(truncated(F.col(text), F.col("allocated")))).drop("__sum", "__n", "__at")


def shared_budget(sections: DataFrame, keys: Sequence[str], need: str, share: str, budget: Column | int, order: str) -> DataFrame:
    """Adds ``granted``: a budget dealt to sections by share, none given more than it needs, what is left dealt out again by share.

    Sections that need least for their share are filled first; the level at which the budget runs out follows from sums over
    those before, so one sorted pass finds it. Whole tokens are granted; those left by rounding go to the first by
    ``order`` that need more. Shares are positive; null needs are 0.
    """
    budget = (F.lit(budget) if isinstance(budget, int) else budget).cast("double")
    n = F.coalesce(F.col(need), F.lit(0)).cast("double")
    s = F.col(share).cast("double")
    by_level = Window.partitionBy(*keys).orderBy(n / s, order)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (budget - F.coalesce(F.sum(n).over(before), F.lit(0.0))) / F.sum(s).over(onward)
    all_ = Window.partitionBy(*keys)
    stuck = F.max(F.when(F.col("__level") < n / s, F.col("__level"))).over(all_)  # levels fall from the first section that is not filled
    dealt = sections.withColumn("__level", level).withColumn("__granted", F.floor(F.least(n, F.greatest(F.lit(0.0), F.coalesce(stuck * s, n)) + 1e-9)).cast("long"))
    spare = (F.floor(F.least(budget, F.sum(n).over(all_))) - F.sum("__granted").over(all_)).cast("long")
    more = dealt.withColumns({"__spare": spare, "__wants": n > F.col("__granted")})
    turn = F.sum(F.col("__wants").cast("long")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    given = more.withColumn("granted", F.col("__granted") + F.when(F.col("__wants") & (turn <= F.col("__spare")), 1).otherwise(0))
    return given.drop("__level", "__granted", "__spare", "__wants")
