"""Trailing statistics over the rows before the current one.

A sliding frame of n rows costs n updates for every row. Here a window of n rows is put together
from windows it is a multiple of: 168 rows are seven blocks of 24, those four blocks of 6, those
two blocks of 3. Each level is a handful of ``lag`` columns over the same sort, and means and
squared deviations of blocks are merged without subtracting large sums. A row has a value only
if all n rows before it do, because a missing value makes every sum it enters missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

MAX_BLOCKS = 32


def gated(value: Column, counted: Column, n: int) -> Column:
    return F.when(counted == n, value)


def sliding(column: str, window: WindowSpec, n: int, how: str) -> Column:
    """One trailing statistic with a plain frame, for sizes that do not nest."""
    frame = window.rowsBetween(-n, -1)
    stat = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how]
    return gated(stat(column).over(frame), F.count(column).over(frame), n)


def block_plan(sizes: Sequence[int]) -> list[tuple[int, int]]:
    """``(size, block)`` per level, smallest first; block 1 means single rows.

    A size that is no small multiple of an earlier one gets block 0: plain frame.
    """
    plan: list[tuple[int, int]] = []
    for n in sorted(set(sizes)):
        fits = [1] + [m for m, b in plan if b > 0]
        block = max((b for b in fits if n % b == 0 and n // b <= MAX_BLOCKS and n > b), default=0)
        plan.append((n, block))
    return plan


def trailing_stats(df: DataFrame, window: WindowSpec, column: str, means: dict[int, str],
                   stds: dict[int, str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds the named trailing means and sample deviations of ``column``.

    ``extra`` are further window columns to compute in the first pass over the same sort.
    """
    temporary: list[str] = []
    pending = dict(extra or {})
    plan = block_plan([*means, *stds])
    # Means are computed under their final name: a later rename would make the optimizer carry
    # every constraint twice per renamed column.
    name_of = {n: means.get(n, f"__mean_{n}") for n, _ in plan}
    for n, block in plan:
        if block > 0:
            continue
        pending |= {means[n]: sliding(column, window, n, "mean")} if n in means else {}
        pending |= {stds[n]: sliding(column, window, n, "std")} if n in stds else {}
    for n, block in plan:
        if block == 0:
            continue
        m, d = name_of[n], f"__dev_{n}"
        if block == 1:
            lags = {f"__row_{n}_{j}": F.lag(column, j).over(window) for j in range(1, n + 1)}
            df = df.withColumns({**pending, **lags})
            parts, deviations = [F.col(c) for c in lags], None
        else:
            bm, bd = name_of[block], f"__dev_{block}"
            steps = range(block, n, block)
            back = {j: (f"__mean_{n}_{j}", f"__dev_{n}_{j}") for j in steps}
            lags = {a: F.lag(bm, j).over(window) for j, (a, _) in back.items()}
            lags |= {b: F.lag(bd, j).over(window) for j, (_, b) in back.items()}
            df = df.withColumns({**pending, **lags})
            parts = [F.col(bm), *(F.col(a) for a, _ in back.values())]
            deviations = [F.col(bd), *(F.col(b) for _, b in back.values())]
        pending = {}
        temporary += [*lags, d, *([] if n in means else [m])]
        df = df.withColumn(m, reduce(add, parts) / F.lit(float(len(parts))))
        spread = reduce(add, [(p - F.col(m)) * (p - F.col(m)) for p in parts]) * float(block)
        df = df.withColumn(d, spread if deviations is None else spread + reduce(add, deviations))
    if pending:
        df = df.withColumns(pending)
    out = {stds[n]: F.sqrt(F.col(f"__dev_{n}") / F.lit(float(n - 1)))
            for n, b in plan if b > 0 and n in stds}
    return df.withColumns(out).drop(*temporary)


def lagged_sum(column: str, window: WindowSpec, n: int) -> Column:
    """Sum of the n rows before this one."""
    return reduce(add, [F.lag(column, j).over(window) for j in range(1, n + 1)])


def lagged_difference(column: str, window: WindowSpec, span: int) -> Column:
    """Change over ``span`` rows, ending at the row before this one."""
    return F.lag(column, 1).over(window) - F.lag(column, 1 + span).over(window)
