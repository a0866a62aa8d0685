"""Boosted regression trees from gradient and hessian sums per bin.

Each feature is cut at quantiles of the training rows, and a row keeps its bin
numbers only. For every level of a tree one pass adds up, per (node, feature,
bin), the gradients and hessians of the rows: tasks add their own rows first,
the sums are combined by an ordinary aggregate, and what reaches the driver has
one cell per bin. Splits, leaf values and their order are worked out from those
sums as the usual second-order boosters do:

* a leaf is worth -soft(G, reg_alpha) / (H + reg_lambda);
* a split gains soft(G)^2 / (H + reg_lambda) of both sides less that of the node,
  and is made only if the gain is positive, at least ``gamma``, and both sides
  have a hessian of ``min_child_weight`` or more;
* with ``max_leaves`` the leaf with the largest gain is split first; one pass
  looks at the children of all leaves that are likely to be split;
* ``subsample`` draws rows anew for every tree by a hash of the row's number,
  ``colsample_bytree`` draws the columns.

The loss is squared error, the first guess the mean of the target. Trees are
kept as arrays; scoring walks them for a batch of rows at a time. Every few
trees the rows are written down with their predictions so far.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadweave.functions.metrics import score
from loadweave.session import ensure_checkpoint_dir

KEEP_EVERY = 10  # trees between two writings of the predictions so far
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    learning_rate: float = 0.1
    n_estimators: int = 100
    max_depth: int = 6  # 0: no limit but that of the leaves
    max_leaves: int = 0  # 0: level by level down to max_depth
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    max_bin: int = 256
    random_state: int = 0
    early_stopping_rounds: int = 50

    @classmethod
    def of(cls, params: Mapping[str, object]) -> Settings:
        """Configured values under their usual names; names that mean nothing here are an error but for those of
        hardware, threads and output."""
        known = {f: type(v) for f, v in asdict(cls()).items()}
        ignored = {"device", "tree_method", "n_jobs", "nthread", "verbosity", "objective", "eval_metric", "grow_policy"}
        if odd := [p for p in params if p not in known and p not in ignored]:
            raise ValueError(f"Unknown boosting parameters: {', '.join(sorted(odd))}")
        given = {p: known[p](v) for p, v in params.items() if p in known and v is not None}
        if given.get("max_leaves") and "max_depth" not in given:
            given["max_depth"] = 0
        made = cls(**given)
        if not made.max_depth and not made.max_leaves:
            raise ValueError("A tree needs a limit: max_depth or max_leaves")
        return made


@dataclass
class Tree:
    """Nodes in the order they were made; a row goes left if its bin is at most ``cut``. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> int:
        """Two new leaves; returns the left one, the right one follows it."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, child, gain
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.value.append(0.0)
            self.gain.append(0.0)
        return child

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """Node each row ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            at = node[rows]
            inner = feature[at] >= 0
            rows, at = rows[inner], at[inner]
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
        return node


@dataclass
class Booster:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    settings: Settings
    errors: list[float] = field(default_factory=list)  # of the validation rows, after each tree

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(d["features"], d["cuts"], d["base"], [Tree(**t) for t in d["trees"]], Settings(**d["settings"]), d["errors"])

    def importance(self) -> dict[str, float]:
        """Total gain of each feature."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    total[self.features[feature]] += gain
        return total


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def worth(g, h, s: Settings):
    """Twice the loss that a leaf with these sums saves; zero where there is nothing."""
    top, below = soft(g, s.reg_alpha) ** 2, np.asarray(h, float) + s.reg_lambda
    return np.divide(top, below, out=np.zeros_like(top), where=below > 0)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-soft(g, s.reg_alpha) / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0


@dataclass(order=True)
class Candidate:
    """Best split of a node; the heap takes the largest gain, then the node made first."""

    order: tuple[float, int]
    feature: int = field(compare=False)
    cut: int = field(compare=False)
    left: tuple[float, float] = field(compare=False)
    right: tuple[float, float] = field(compare=False)

    @property
    def gain(self) -> float:
        return -self.order[0]


def best_split(node: int, g: np.ndarray, h: np.ndarray, s: Settings) -> Candidate | None:
    """Best cut of a node from its (feature, bin) sums; ties go to the smaller feature, then the smaller bin."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    g_all, h_all = gl[:, -1:], hl[:, -1:]
    gain = worth(gl, hl, s) + worth(g_all - gl, h_all - hl, s) - worth(g_all, h_all, s)
    allowed = (hl >= s.min_child_weight) & (h_all - hl >= s.min_child_weight) & (hl > 0) & (h_all - hl > 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[f, b])
    if not best > _LEAST_GAIN or best < s.gamma:
        return None
    left = float(gl[f, b]), float(hl[f, b])
    return Candidate((-best, node), int(f), int(b), left, (float(g_all[f, 0]) - left[0], float(h_all[f, 0]) - left[1]))


# ---- rows ------------------------------------------------------------------

def cut_points(rows: DataFrame, features: Sequence[str], max_bin: int) -> list[list[float]]:
    """Ascending cuts of each feature; a value's bin is the number of cuts below it."""
    share = [k / max_bin for k in range(1, max_bin)]
    found = rows.approxQuantile(list(features), share, 0.1 / max_bin)
    return [sorted({float(c) for c in cuts}) for cuts in found]


def _binned(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and the bins of all features as 16-bit numbers in one binary."""
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.empty((batch.num_rows, len(edges)), "<u2")
            for f, edge in enumerate(edges):
                wide[:, f] = np.searchsorted(edge, batch.column(len(keep) + f).to_numpy(zero_copy_only=False), side="left")
            data = pa.array([row.tobytes() for row in wide], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], data], [*keep, "_bins"])

    chosen = rows.select(*keep, *[F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(features)])
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _bins binary")


def _matrix(column: pa.Array, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), n_features)


def _sum_of(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += np.array(tree.value)[tree.leaves_of(bins)]
    return total


def _drawn(numbers: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Rows of a tree's sample: a mixed hash of row, tree and seed, below the share."""
    if s.subsample >= 1:
        return np.ones(len(numbers), bool)
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0x632BE59BD9B4E019 + s.random_state) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(s.subsample * (2**64 - 1)))


def _histograms(
    rows: DataFrame, pending: list[Tree], tree: Tree, nodes: Sequence[int], number: int, columns: np.ndarray, bins_of: int, s: Settings,
    n_features: int,
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient and hessian sums (feature, bin) of some leaves; at most one cell per node, feature and bin reaches the driver."""
    slot = {node: k for k, node in enumerate(nodes)}
    size = len(nodes) * len(columns) * bins_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_all, h_all = np.zeros(size), np.zeros(size)
        place = np.full(len(tree.feature), -1)
        for node, k in slot.items():
            place[node] = k
        for batch in batches:
            bins = _matrix(batch.column(0), n_features)
            y, margin, numbers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            here = place[tree.leaves_of(bins)]
            use = (here >= 0) & _drawn(numbers, number, s)
            bins, here = bins[use], here[use]
            g = (margin[use] + _sum_of(pending, bins)) - y[use]
            for f, column in enumerate(columns):
                cell = (here * len(columns) + f) * bins_of + bins[:, column]
                g_all += np.bincount(cell, g, size)
                h_all += np.bincount(cell, minlength=size)
        used = np.flatnonzero(h_all)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(g_all[used]), pa.array(h_all[used])], ["cell", "g", "h"])

    parts = rows.select("_bins", "_y", "_margin", "_number").mapInArrow(run, "cell long, g double, h double")
    cells = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    g_all, h_all = np.zeros(size), np.zeros(size)
    at = cells.column("cell").to_numpy()
    g_all[at], h_all[at] = cells.column("g").to_numpy(), cells.column("h").to_numpy()
    shape = len(nodes), len(columns), bins_of
    return {node: (g, h) for node, g, h in zip(nodes, g_all.reshape(shape), h_all.reshape(shape))}


def grow(rows: DataFrame, pending: list[Tree], number: int, bins_of: int, s: Settings, n_features: int) -> Tree:
    """One tree on the gradients of the rows.

    Splits are tried in a larger tree first: every round takes the splits in
    order of gain as far as they are known, looks up the children of all those
    in one pass, and starts over, until nothing that is taken is unknown. The
    order is therefore that of one split at a time.
    """
    rng = np.random.default_rng([s.random_state, number])
    take = max(1, math.floor(s.colsample_bytree * n_features))
    columns = np.sort(rng.choice(n_features, take, replace=False))
    tried, depth = Tree(), {0: 0}
    sums: dict[int, tuple[float, float]] = {}
    found: dict[int, Candidate | None] = {}
    unseen = [0]
    while True:
        if unseen:
            for node, (g, h) in _histograms(rows, pending, tried, unseen, number, columns, bins_of, s, n_features).items():
                sums.setdefault(node, (float(g[0].sum()), float(h[0].sum())))
                found[node] = best_split(node, g, h, s)
        heap = [found[0]] if found[0] else []
        taken: list[int] = []
        unknown: list[Candidate] = []
        while heap and (not s.max_leaves or len(taken) + 1 < s.max_leaves):
            best = heapq.heappop(heap)
            node = best.order[1]
            taken.append(node)
            if tried.feature[node] < 0:
                unknown.append(best)
                continue
            for child in (tried.left[node], tried.left[node] + 1):
                if found.get(child):
                    heapq.heappush(heap, found[child])
        if not unknown:
            return _kept(tried, set(taken), sums, s)
        unseen = []
        for best in unknown:
            node = best.order[1]
            child = tried.split(node, int(columns[best.feature]), best.cut, best.gain)
            for k, side in ((child, best.left), (child + 1, best.right)):
                sums[k], depth[k] = side, depth[node] + 1
                if not s.max_depth or depth[k] < s.max_depth:
                    unseen.append(k)


def _kept(tried: Tree, taken: set[int], sums: Mapping[int, tuple[float, float]], s: Settings) -> Tree:
    """The tree of the splits that were taken, with the values of its leaves."""
    tree, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop(0)
        if old in taken:
            child = tree.split(new, tried.feature[old], tried.cut[old], tried.gain[old])
            todo += [(tried.left[old], child), (tried.left[old] + 1, child + 1)]
        else:
            tree.value[new] = s.learning_rate * leaf_value(*sums[old], s)
    return tree


def fit(
    rows: DataFrame, features: Sequence[str], y: str = "y", settings: Settings = Settings(), validation: str | None = None
) -> Booster:
    """Trees on the rows where ``validation`` is not set, as many as give the validation rows their least error.

    Without validation rows all configured trees are kept. Rows must be complete.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    s, features = settings, list(features)
    flag = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    used = rows.select(*features, F.col(y).cast("double").alias("_y"), flag.alias("_val"))
    training = used.where(~F.col("_val"))
    base, n = training.agg(F.avg("_y"), F.count("*")).first()
    if not n:
        raise ValueError("There are no rows to train on")
    cuts = cut_points(training, features, s.max_bin)
    bins_of = max(map(len, cuts)) + 1
    current = _binned(used, features, cuts, ["_y", "_val"]).select(
        "*", F.lit(float(base)).alias("_margin"), F.monotonically_increasing_id().alias("_number")).checkpoint()
    trees: list[Tree] = []
    pending: list[Tree] = []
    errors: list[float] = []
    best = 0
    for number in range(s.n_estimators):
        tree = grow(current.where(~F.col("_val")), pending, number, bins_of, s, len(features))
        trees.append(tree)
        pending.append(tree)
        if validation:
            errors.append(_error(current.where("_val"), pending, len(features)))
            best = min(range(len(errors)), key=lambda k: (errors[k], k))
            if number - best >= s.early_stopping_rounds:
                break
        if len(pending) == KEEP_EVERY:
            current = _advanced(current, pending, len(features)).checkpoint()
            pending = []
    if validation and not all(math.isnan(e) for e in errors):
        trees = trees[: best + 1]
    return Booster(features, cuts, float(base), trees, s, errors)


def _advanced(rows: DataFrame, trees: list[Tree], n_features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column(3).to_numpy(zero_copy_only=False) + _sum_of(trees, _matrix(batch.column(2), n_features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin), batch.column(4)], batch.schema.names)

    return rows.select("_y", "_val", "_bins", "_margin", "_number").mapInArrow(
        run, "_y double, _val boolean, _bins binary, _margin double, _number long")


def _error(rows: DataFrame, pending: list[Tree], n_features: int) -> float:
    """Root mean squared error of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            y, margin = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            total += float(((margin + _sum_of(pending, _matrix(batch.column(0), n_features)) - y) ** 2).sum())
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total])], ["n", "total"])

    n, total = rows.select("_bins", "_y", "_margin").mapInArrow(run, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    return math.sqrt(total / n) if n else math.nan


def predict(booster: Booster, rows: DataFrame, out: str = "y_hat") -> DataFrame:
    """The rows with their prediction; rows with a missing feature are refused by the caller's ``na.drop``."""
    keep = rows.columns
    n_features, trees, base = len(booster.features), booster.trees, booster.base
    numbered = _binned(rows, booster.features, booster.cuts, keep)
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess = base + _sum_of(trees, _matrix(batch.column(len(keep)), n_features))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(guess)], [*keep, out])

    return numbered.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{out}` double")


@dataclass
class TrainedTrees:
    model: Booster
    rounds: int
    predictions: DataFrame
    metrics: DataFrame


def train(
    rows: DataFrame, features: Sequence[str], params: Mapping[str, object] | None = None, y: str = "y", refit: bool = True
) -> TrainedTrees:
    """Fit on train with early stopping on val, refit on both with that many trees, predict every split.

    The validation errors come from the model before the refit, as their label says.
    """
    s, kept = Settings.of(params or {}), rows.persist()
    fitting = kept.where("split <> 'test'").withColumn("_is_val", F.col("split") == "val")
    has_val = not fitting.where("_is_val").isEmpty()
    first = fit(fitting, features, y, s, "_is_val" if has_val else None)
    again = refit and has_val
    model = fit(fitting, features, y, replace(s, n_estimators=len(first.trees))) if again else first
    kept.unpersist()
    predictions = scored(model, rows, y)
    part = F.when(F.col("split") == "test", "Test").when(F.lit(again) | (F.col("split") == "train"), "Train+Val" if again else "Train")
    parts = predictions.withColumn("part", part).where(F.col("part").isNotNull())
    if has_val:
        early = scored(first, rows.where("split = 'val'"), y).withColumn("part", F.lit("Val (pre-refit)" if refit else "Val"))
        parts = parts.unionByName(early)
    return TrainedTrees(model, len(first.trees), predictions, score(parts, "part"))


def scored(booster: Booster, rows: DataFrame, y: str = "y", keys: Sequence[str] = ("id",)) -> DataFrame:
    """(split, keys, ts, y, y_hat) of complete rows."""
    return predict(booster, rows).select("split", *keys, "ts", F.col(y).alias("y"), "y_hat")
