"""Histogram sort into shards of near-equal bytes.

Rows are ordered by a composite key of two longs. For every splitter the exact
bytes below candidate boundaries are counted across all partitions; the
candidates are refined until one lies within the tolerance of its target, or
the key is exhausted. Then the rows are exchanged once, by range of (shard,
key), and numbered. The driver sees a few thousand counts per splitter and
round, whatever the number of rows.

Rows with equal keys (the same text and id) stay together. An empty table gives
an empty result; with fewer rows than shards some shards stay empty. Null keys
are taken as zero.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadweave.llm.common import shuffle_parts, stored

FEW = 16_384  # rows around all open splitters that are looked at one by one
STEP = 8  # key bits resolved per round: 256 candidate boundaries for each open splitter
ROUNDS = 64 // STEP
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _prefix(column: str, bits: int) -> Column:
    return F.shiftright(F.col(column), 64 - bits) if bits else F.lit(0).cast("long")


def _finer_counts(df: DataFrame, size: str, depth: int, within: set[tuple[int, int]]) -> dict[tuple[int, int], list]:
    """Each candidate interval of this round, by the interval it refines: sorted (prefix, bytes, rows)."""
    level = depth if depth <= ROUNDS else depth - ROUNDS
    column, known = ("_hi", F.lit(0).cast("long")) if depth <= ROUNDS else ("_lo", F.col("_hi"))
    coarse, fine = _prefix(column, STEP * (level - 1)), _prefix(column, STEP * level)
    if depth > ROUNDS:
        df = df.where(F.col("_hi").isin(sorted({w[0] for w in within})))
    if level > 1:
        df = df.where(coarse.isin(sorted({w[1] for w in within})))
    out: dict[tuple[int, int], list] = defaultdict(list)
    for r in df.groupBy(known.alias("a"), coarse.alias("b"), fine.alias("c")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).collect():
        out[(r.a, r.b)].append((r.c, int(r.n), r.rows))
    return {k: sorted(v) for k, v in out.items()}


def splitters(df: DataFrame, size: str, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Lower bounds (hi, lo) of shards 1 to n - 1.

    The bytes below each are within `tolerance` of a shard of their target, or
    as near as whole rows allow.
    """
    total = int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    pending = {k: ((0, 0), 0) for k in range(1, shards)} if total else {}  # splitter -> (interval, bytes below it)
    for depth in range(1, 2 * ROUNDS + 1):
        counts = _finer_counts(df, size, depth, {interval for interval, _ in pending.values()}) if pending else {}
        width = 64 - STEP * (depth if depth <= ROUNDS else depth - ROUNDS)
        refined, around = {}, {}
        for k, (interval, below) in pending.items():
            target = total * k / shards
            for prefix, n, rows in counts[interval]:
                if below + n >= target:
                    break
                below += n
            start, end = prefix << width, min((prefix + 1) << width, HIGH)
            if min(target - below, below + n - target) <= slack or depth == 2 * ROUNDS:
                bound = start if target - below <= below + n - target else end
                done[k] = (bound, LOW) if depth <= ROUNDS else (interval[0], bound)
                continue
            if depth < ROUNDS:
                refined[k] = ((0, prefix), below)
            elif depth == ROUNDS:
                refined[k] = ((prefix, 0), below)  # one key: go on with its second part
            else:
                refined[k] = ((interval[0], prefix), below)
            around[refined[k][0]] = rows
        pending = refined
        if pending and sum(around.values()) <= FEW:
            done |= _among_few(df, size, depth, pending, {k: total * k / shards for k in pending})
            break
    return [done.get(k, (LOW, LOW)) for k in range(1, shards)]


def _among_few(df: DataFrame, size: str, depth: int, pending: dict, target: dict[int, float]) -> dict[int, tuple[int, int]]:
    """Settle the open splitters from the keys of at most FEW rows."""
    if depth < ROUNDS:
        interval = F.struct(F.lit(0).cast("long").alias("a"), _prefix("_hi", STEP * depth).alias("b"))
    else:
        interval = F.struct(F.col("_hi").alias("a"), _prefix("_lo", STEP * (depth - ROUNDS)).alias("b"))
    wanted = {w for w, _ in pending.values()}
    near = df.where(interval["a"].isin(sorted({a for a, _ in wanted})) & interval["b"].isin(sorted({b for _, b in wanted})))
    keys: dict[tuple[int, int], list] = defaultdict(list)
    for r in near.groupBy(interval.alias("i"), "_hi", "_lo").agg(F.sum(size).alias("n")).collect():
        keys[(r.i.a, r.i.b)].append((r["_hi"], r["_lo"], int(r.n)))
    done = {}
    for k, (w, below) in pending.items():
        bound = (LOW, LOW)
        for hi, lo, n in sorted(keys[w]):
            bound = (hi, lo)
            if below + n >= target[k]:
                if target[k] - below > below + n - target[k]:
                    bound = (hi, lo + 1) if lo < HIGH else (hi + 1, LOW)
                break
            below += n
        done[k] = bound
    return done


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the row's key."""
    out = F.lit(0)
    for hi, lo in bounds:
        at_or_above = (F.col("_hi") > hi) | ((F.col("_hi") == hi) & (F.col("_lo") >= lo))
        out = out + at_or_above.cast("int")
    return out


def histogram_sort(
    df: DataFrame, hi: Column, lo: Column, size: Column, shards: int = 16, tolerance: float = 0.0025,
) -> DataFrame:
    """Add `shard` and `slot` (place within the shard, from 0) to all rows of `df`.

    `hi`, `lo`: the key, two long columns; use hashes where the order itself does not matter.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    key = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    rows = stored(
        df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key(hi).alias("_hi"), key(lo).alias("_lo"),
                  key(size).alias("_size")), "keyed",
    )
    bounds = splitters(rows, "_size", shards, tolerance)
    place = F.monotonically_increasing_id()
    dealt = stored(
        rows.withColumn("shard", shard_of(bounds))
        .repartitionByRange(shuffle_parts(df.sparkSession), "shard", "_hi", "_lo")
        .sortWithinPartitions("shard", "_hi", "_lo")
        .select("_row", "shard", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")),
        "dealt",
    )
    # partitions + shards rows: where each run of a shard starts, and how many rows of the shard lie before it
    runs = dealt.groupBy("_part", "shard").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).drop("_n")
    return dealt.join(runs, ["_part", "shard"]).select(
        "_row.*", F.col("shard").cast("int").alias("shard"),
        (F.col("_place") - F.col("_first") + F.col("_before")).cast("long").alias("slot"),
    )


def write_shards(sorted_rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file; a shard may have several files."""
    parts = shuffle_parts(sorted_rows.sparkSession)
    sorted_rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
