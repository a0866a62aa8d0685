"""Least squares per series from sums that Spark adds up.

A regression needs only the sums of products of its columns. Each Arrow batch
contributes one small matrix per key, the cells are added with an ordinary
partial aggregation, and what is solved per key is a k x k system. No series
is ever gathered to be fitted, and every candidate that uses a subset of the
columns is a sub-block of the same matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def moment_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | str) -> DataFrame:
    """(keys, moments, rows): upper triangle of sum(c_i * c_j), row by row.

    ``columns`` are the columns, or the name of one array column that holds
    them. Rows with a missing value are left out. Packing the values into one
    array keeps the plan small however many columns there are.
    """
    keys = list(keys)
    packed = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    fields = [f for f in df.select(*keys).schema] + [T.StructField("part", T.ArrayType(T.DoubleType()))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            if not len(lists):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            named = pa.Table.from_batches([batch.select(range(len(keys)))]).to_pandas()
            group = named.groupby(keys, sort=False).ngroup().to_numpy()  # -1 where a key is null
            order = np.argsort(group, kind="stable")
            order = order[group[order] >= 0]
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            cells = np.triu_indices(x.shape[1])
            sums = np.empty((len(starts), len(cells[0]) + 1))
            for i, rows in enumerate(np.split(order, starts[1:])):
                sums[i, :-1], sums[i, -1] = (x[rows].T @ x[rows])[cells], len(rows)
            offsets = pa.array(np.arange(len(starts) + 1) * sums.shape[1], pa.int32())
            parts = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
            firsts = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(firsts) for k in range(len(keys))), parts], [*keys, "part"])

    complete = df.select(*keys, packed.alias("_row")).where(F.forall("_row", lambda v: v.isNotNull() & ~F.isnan(v)))
    cells = (
        complete.mapInArrow(partial, T.StructType(fields))
        .select(*keys, F.posexplode("part").alias("cell", "value"))
        .groupBy(*keys, "cell")
        .agg(F.sum("value").alias("value"))
    )
    # One bounded list per key: k * (k + 1) / 2 cells and the row count.
    whole = cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda c: c["value"]).alias("_all")
    )
    return whole.select(
        *keys,
        F.slice("_all", F.lit(1), F.size("_all") - 1).alias("moments"),
        F.element_at("_all", -1).alias("rows"),
    )


def unpack(moments: Sequence[float], k: int) -> np.ndarray:
    """Symmetric matrix from its stored upper triangle."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = moments
    return m + np.triu(m, 1).T


def independent(
    gram: np.ndarray, chosen: Sequence[int], tol: float = 1e-10, known: dict[tuple[int, ...], bool] | None = None
) -> list[int]:
    """Columns of ``chosen`` that are not zero or a combination of earlier ones.

    One Gram-Schmidt sweep on the matrix of products; a column is kept if the
    part of its length that is new exceeds ``tol``. ``known`` keeps what was
    found out for one matrix and ``tol``, for further choices of its columns.
    """
    kept: list[int] = []
    known = {} if known is None else known
    for j in chosen:
        if (new := known.get((*kept, j))) is not None:
            kept += [j] * new
            continue
        length = gram[j, j]
        if length <= 0:
            continue
        rest = length
        if kept:
            block = gram[np.ix_(kept, kept)]
            rest = length - gram[j, kept] @ np.linalg.lstsq(block, gram[kept, j], rcond=None)[0]
        known[*kept, j] = bool(rest / length > tol)
        if rest / length > tol:
            kept.append(j)
    return kept


def solve(gram: np.ndarray, target: int, chosen: Sequence[int], penalty: np.ndarray | None = None) -> np.ndarray:
    """Full-length coefficient vector of target ~ chosen, zeros elsewhere."""
    out = np.zeros(len(gram))
    if not len(chosen):
        return out
    block = gram[np.ix_(chosen, chosen)].copy()
    if penalty is not None:
        block += np.diag(penalty[list(chosen)])
    try:
        beta = np.linalg.solve(block, gram[chosen, target])
    except np.linalg.LinAlgError:
        ridge = 1e-8 * max(np.trace(block), 1.0)
        beta = np.linalg.solve(block + ridge * np.eye(len(block)), gram[chosen, target])
    out[list(chosen)] = beta
    return out


def sparse_solve(
    gram: np.ndarray, target: int, ridge: np.ndarray, absolute: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-9
) -> np.ndarray:
    """Least squares from a matrix of products with squared and absolute-value penalties.

    Minimises half the squared error plus half of ridge_j b_j^2 plus
    absolute_j |b_j|, all columns but ``target``. An active set of signed
    coefficients is solved exactly; on the way to its solution the step stops
    where a sign would change for the worse, and the inactive column that breaks
    its optimality condition most comes in next. ``start`` is a solution nearby.
    """
    k = target
    a, b = gram[:k, :k] + np.diag(ridge[:k]), gram[:k, target]
    cost = absolute[:k]
    scale = max(float(np.abs(b).max(initial=0.0)), 1e-300)
    free = cost <= 0
    beta = np.zeros(k) if start is None else start[:k].copy()
    sign = np.where(free, 0.0, np.sign(beta))
    active = free | (sign != 0)

    def loss(x: np.ndarray) -> float:
        return float(0.5 * x @ a @ x - b @ x + cost @ np.abs(x))

    for _ in range(50 * (k + 1)):
        on = np.flatnonzero(active)
        if len(on):
            wanted = np.zeros(k)
            wanted[on] = np.linalg.lstsq(a[np.ix_(on, on)], b[on] - (cost * sign)[on], rcond=None)[0]
            # the best point of the way there: its end, or where a coefficient crosses zero
            crosses = on[(~free[on]) & (sign[on] * wanted[on] < 0) & (beta[on] != 0)]
            shares = np.unique(np.append(beta[crosses] / (beta[crosses] - wanted[crosses]), 1.0)) if len(crosses) else np.array([1.0])
            points = [beta + share * (wanted - beta) for share in shares]
            for point, share in zip(points, shares):
                point[[c for c in crosses if abs(beta[c] / (beta[c] - wanted[c]) - share) < 1e-15]] = 0.0
            beta = min(points, key=loss)
            sign = np.where(free, 0.0, np.where(beta != 0, np.sign(beta), np.where(active & ~free & (sign * wanted > 0), sign, 0.0)))
            active = free | (beta != 0)
        slope = a @ beta - b
        off = slope + cost * sign
        if np.abs(off[active]).max(initial=0.0) > tol * scale and len(on):
            settled = np.abs(off[active]).max() <= 1e-6 * scale and np.allclose(beta, wanted)
            if not settled:
                continue
        rest = np.flatnonzero(~active)
        excess = np.abs(slope[rest]) - cost[rest]
        if not len(rest) or excess.max() <= tol * scale:
            break
        new = rest[int(np.argmax(excess))]
        sign[new], active[new] = -np.sign(slope[new]), True
    out = np.zeros(len(gram))
    out[:k] = beta
    return out


def dot(coefficients: str, values: Sequence[str] | str) -> Column:
    """Sum of coefficient times value, over columns or one array column."""
    packed = F.col(values) if isinstance(values, str) else F.array(*[F.col(c).cast("double") for c in values])
    products = F.zip_with(F.col(coefficients), packed, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def independent_columns(df: DataFrame, columns: Sequence[str], tol: float = 1e-5) -> list[str]:
    """Columns that are neither constant nor a linear combination of earlier ones, in order.

    Columns are centred and scaled with moments of a first pass, so neither a
    large mean nor a small unit hides what is new in them; a column is kept if
    the length of its new part exceeds ``tol`` of its own. Rows with a missing
    value are left out.
    """
    columns = list(columns)
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        complete = complete.where(F.col(c).isNotNull() & ~F.isnan(c))
    facts = complete.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    spread = {c: facts[f"std_{c}"] for c in columns}
    varying = [c for c in columns if spread[c] and spread[c] > 1e-12 * max(1.0, abs(facts[f"mean_{c}"]))]
    if len(varying) < 2:
        return varying
    scaled = complete.select(F.lit(1).alias("_one"), *[((F.col(c) - facts[f"mean_{c}"]) / spread[c]).alias(c) for c in varying])
    gram = unpack(moment_matrix(scaled, ["_one"], varying).first()["moments"], len(varying))
    return [varying[i] for i in independent(gram, range(len(varying)), tol**2)]


def independent_per_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tol: float = 1e-5) -> DataFrame:
    """(keys, kept): for each series the columns that neither are constant there nor combine earlier ones.

    The same screen as over all rows, from one matrix of products per series,
    centred by the series' own means. Rows with a missing value are left out;
    a series without a complete row has no row here.
    """
    keys, columns = list(keys), list(columns)
    complete = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        complete = complete.where(F.col(c).isNotNull() & ~F.isnan(c))
    means = complete.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("_means"))
    centred = complete.join(means, keys).select(*keys, F.zip_with(F.array(*columns), "_means", lambda v, m: v - m).alias("_c"))
    joined = moment_matrix(centred, keys, "_c").join(means, keys)

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for moments, n, mean in zip(batch["moments"], batch["rows"], batch["_means"]):
                gram = unpack(moments, len(columns))
                spread = np.sqrt(np.maximum(np.diag(gram), 0) / n)
                varying = np.flatnonzero(spread > 1e-12 * np.maximum(1.0, np.abs(mean)))
                scaled = gram / np.outer(np.where(spread > 0, spread, 1), np.where(spread > 0, spread, 1))
                kept.append([columns[i] for i in independent(scaled, varying.tolist(), tol**2)])
            yield batch[keys].assign(kept=kept)

    schema = T.StructType([*joined.select(*keys).schema, T.StructField("kept", T.ArrayType(T.StringType()))])
    return joined.mapInPandas(screen, schema)


def usable_features(df: DataFrame, columns: Sequence[str], tol: float = 1e-5) -> list[str]:
    """Drop non-numeric, constant and collinear feature columns, keeping order.

    Only a k x k matrix and moments of k columns reach the driver.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = dict(df.dtypes)
    named = [c for c in columns if kinds[c] in numeric or kinds[c].startswith("decimal")]
    if not named:
        return []
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in named], *[F.max(c).alias(f"hi_{c}") for c in named],
                  *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in named], F.count("*").alias("n")).first()
    varying = [
        c for c in named
        if ends[f"lo_{c}"] != ends[f"hi_{c}"] or 0 < ends[f"na_{c}"] < ends["n"]
    ]
    # a column that is constant where it is filled still tells filled rows from others
    filled = [c for c in varying if ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    kept = set(independent_columns(df, filled, tol)) if filled else set()
    return [c for c in varying if c in kept or c not in filled]


def feature_diagnostics(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Non-numeric and constant columns, matrix rank, sizes of dummy families."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] in ("string", "binary", "date") or kinds[c].startswith(("array", "map"))]
    numeric = [c for c in columns if c not in text]
    spread = df.agg(*[F.count_distinct(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    families: dict[str, int] = {}
    for c in columns:
        head = c.rsplit("_", 1)[0]
        families[head] = families.get(head, 0) + 1
    return {
        "non_numeric": text,
        "zero_variance": [c for c, n in spread.items() if n <= 1],
        "columns": len(columns),
        "rank": len(usable_rank(df, numeric)),
        "families": {k: n for k, n in families.items() if n > 1},
    }


def usable_rank(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that add a dimension to the feature matrix, one constant included."""
    filled = df.na.drop(subset=list(columns)) if columns else df
    kept = set(independent_columns(df, columns)) if columns else set()
    ends = filled.agg(*[F.max(c).alias(c) for c in columns], *[F.min(c).alias(f"lo_{c}") for c in columns]).first() if columns else {}
    constant = [c for c in columns if c not in kept and ends[c] is not None and ends[c] == ends[f"lo_{c}"] != 0][:1]
    return [c for c in columns if c in kept or c in constant]
