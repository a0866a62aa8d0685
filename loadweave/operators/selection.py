"""Candidate grids, pruning by series length, and picking the best candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

# Column names of an order; the seasonal ones are sp, sd, sq because Spark
# does not tell P from p.
ORDER_FIELDS = ("p", "d", "q", "sp", "sd", "sq", "m")

Order = tuple[int, int, int, int, int, int, int]


def order_grid(search: Mapping[str, object], seasonal_period: int, quick: Mapping[str, object] | None = None) -> list[Order]:
    """All (p, d, q, P, D, Q, m) of a search space, non-seasonal parts outermost.

    ``quick`` may name preferred ``orders`` and ``seasonal_orders``; without any
    that are in the grid, the first three and first two are taken.
    """
    axes = {k: [int(v) for v in search.get(k, [0])] for k in "pdqPDQ"}
    plain = list(product(axes["p"], axes["d"], axes["q"]))
    if search.get("seasonal", True) and seasonal_period > 0:
        seasonal = [(*o, seasonal_period) for o in product(axes["P"], axes["D"], axes["Q"])]
    else:
        seasonal = [(0, 0, 0, 0)]
    if quick is not None:
        def preferred(wanted, grid, count):
            named = [tuple(w) for w in dict.fromkeys(map(tuple, wanted or []))]
            return [w for w in named if w in grid] or grid[:count]

        plain = preferred(quick.get("orders"), plain, 3)
        seasonal = preferred(
            [(*s[:3], s[3] if len(s) > 3 else seasonal_period) for s in quick.get("seasonal_orders") or []], seasonal, 2
        )
    return [(*o, *s) for o in plain for s in seasonal]


# Fixed preferences of the quick exogenous grid.
QUICK_ORDERS = ((1, 1, 1), (1, 1, 0), (2, 1, 1))
QUICK_SEASONAL = ((1, 1, 1), (0, 1, 1))


def grid_array(orders: Sequence[Order]) -> Column:
    """The grid as an array literal of structs carrying their index."""
    fields = ("candidate", *ORDER_FIELDS)
    rows = [
        "named_struct(" + ", ".join(f"'{n}', {int(v)}" for n, v in zip(fields, (i, *o))) + ")"
        for i, o in enumerate(orders)
    ]
    return F.expr(f"array({', '.join(rows)})")


def candidates_per_series(lengths: DataFrame, orders: Sequence[Order], n: str = "n") -> DataFrame:
    """Every series with its admissible candidates.

    A seasonal AR or MA term needs five seasons of history; a series that
    admits nothing keeps the whole grid.
    """
    grid = grid_array(orders)
    fits = F.filter(
        grid, lambda c: ~((F.col(n) < 5 * F.greatest(c["m"], F.lit(1))) & (c["sp"] + c["sq"] > 0))
    )
    chosen = F.when(F.size(fits) > 0, fits).otherwise(grid)
    return lengths.select("*", F.inline(chosen))


def best_candidate(trials: DataFrame, keys: Sequence[str], score: str = "WAPE", order: str = "candidate") -> DataFrame:
    """Lowest score per key; NaN and null never win, ties go to the first.

    An aggregate with partial results, so the trials of one key need not meet
    in one place.
    """
    valid = trials.where(F.col(score).isNotNull() & ~F.isnan(score))
    rest = [c for c in trials.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(score, order)).alias("_b")
    return valid.groupBy(*keys).agg(best).select(*keys, "_b.*")
