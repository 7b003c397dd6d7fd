"""Multi-class boosting on histograms: one softmax tree a class and round, with L1 and L2 penalties on leaves.

Features are binned once. A level of all classes' trees is one job: tasks sum gradients and Hessians by class, node, feature
and bin, a node's sums go through a shuffle as one array a task, and each node's best split, a row, comes to the driver. Leaf values follow from the same sums. Margins are stored with the rows every ROUNDS rounds; in between a
task adds the newest trees' outputs. Validation losses of those rounds are one job, and a model that stops early keeps the
trees up to its best round: nothing is fitted twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Boosting
from ..sources.stored import discard, stored

#: Rounds whose trees are added up in each task before margins are stored anew; sums that a task holds between batches.
ROUNDS, CELLS = 10, 1 << 24

_ROWS = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("bins", pa.binary()), ("margin", pa.list_(pa.float64()))])
ROWS = "id long, y int, bins binary, margin array<double>"
_SUMS = pa.schema([("class", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])
SUMS = "class int, node int, sums binary"
_BEST = pa.schema([("class", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), *(pa.field(c, pa.float64()) for c in ("gain", "gl", "hl", "nl", "g", "h", "n"))])
BEST = "class int, node int, feature int, bin int, gain double, gl double, hl double, nl double, g double, h double, n double"


@dataclass
class Growing:
    """A tree's nodes; leaves have left = -1. bin: the last bin that goes left; g, h, n: sums over the node's rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [1.0])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    n: list[float] = field(default_factory=lambda: [1.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float, left: tuple, right: tuple) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, at, a, a + 1, gain
        for g, h, n in (left, right):
            for name, x in zip(("feature", "bin", "left", "right", "gain", "g", "h", "n", "value"), (-1, -1, -1, -1, 0.0, g, h, n, 0.0), strict=True):
                getattr(self, name).append(x)
        return a, a + 1


def nodes_of(tree: Growing, bins: np.ndarray) -> np.ndarray:
    """The node that each row has come to."""
    feature, at, left, right = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right))
    node = np.zeros(len(bins), np.int64)
    on = np.flatnonzero(left[node] >= 0)
    while len(on):
        k = node[on]
        node[on] = np.where(bins[on, feature[k]] <= at[k], left[k], right[k])
        on = on[left[node[on]] >= 0]
    return node


def margins(given: np.ndarray, trees: list[list[Growing]], bins: np.ndarray) -> np.ndarray:
    """given and the outputs of trees by round and class."""
    out = given.copy()
    for of_round in trees:
        for c, tree in enumerate(of_round):
            out[:, c] += np.array(tree.value)[nodes_of(tree, bins)]
    return out


def shares(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss by the margins, of each row and class."""
    p = shares(m)
    return p - (np.arange(m.shape[1]) == y[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def sampled(ids: np.ndarray, number: int, p: Boosting) -> np.ndarray:
    """Rows that a round's trees are made from: by a hash of the row's id, so that layout doesn't matter."""
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((p.seed * 1_000_003 + number) * 0xBF58476D1CE4E5B9 % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2.0**53 < p.subsample


def columns(number: int, c: int, n: int, p: Boosting) -> np.ndarray:
    """Features that a class's tree of a round may split on."""
    return np.sort(np.random.default_rng([p.seed, number, c]).permutation(n)[: max(1, int(p.columns * n))])


def shrunk(g: np.ndarray, p: Boosting) -> np.ndarray:
    """A sum of gradients, nearer to zero by the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)


def worth(g: np.ndarray, h: np.ndarray, p: Boosting) -> np.ndarray:
    return shrunk(g, p) ** 2 / (h + p.l2)


def best_bins(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of sums by bin, the bin to split behind and its gain; -inf if no split leaves enough on both sides."""
    gl, hl = np.cumsum(g, 1), np.cumsum(h, 1)
    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
    gain = worth(gl, hl, p) + worth(gr, hr, p) - worth(gl[:, -1:], hl[:, -1:], p)
    gain[(hl < p.least_child) | (hr < p.least_child) | (np.cumsum(n, 1) == 0) | (np.cumsum(n, 1) == n.sum(1, keepdims=True))] = -np.inf
    at = gain.argmax(1)
    return at, gain[np.arange(len(at)), at]


def cut_points(rows: DataFrame, p: Boosting, features: str = "features") -> list[np.ndarray]:
    """Of each feature the ascending values that bins begin at; sketches are combined before the shuffle."""
    x = rows.select(F.posexplode(features).alias("i", "x"))
    quantiles = F.percentile_approx("x", [k / p.bins for k in range(1, p.bins)], 10 * p.bins)
    found = {r["i"]: r for r in x.groupBy("i").agg(quantiles.alias("q"), F.min("x").alias("low")).collect()}  # a row for each feature
    return [np.array(sorted({q for q in found[i]["q"] if q > found[i]["low"]})) for i in range(len(found))]


def binned(rows: DataFrame, cuts: list[np.ndarray], classes: int, features: str = "features") -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b["x"].to_numpy(zero_copy_only=False))
                bins = np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([[0.0] * classes] * len(x), pa.list_(pa.float64()))], schema=_ROWS)

    values = F.transform(features, lambda v: v.cast("double"))
    # dealt over all tasks, as every level visits all rows: a table of small rows may come in a partition or two
    dealt = rows.select(F.xxhash64(values, "y").alias("id"), F.col("y").cast("int").alias("y"), values.alias("x")).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, ROWS)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(b["bins"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return b["id"].to_numpy(), b["y"].to_numpy(), bins, np.stack(b["margin"].to_numpy(zero_copy_only=False))


def level(rows: DataFrame, newest: list[list[Growing]], trees: list[Growing], live: list[list[int]], number: int, n_features: int, p: Boosting) -> list:
    """The best split of each live node of all classes: a row for each, gain null where there is none."""
    given = rows.sparkSession.sparkContext.broadcast((newest, trees, live))  # bounded by the model's parameters

    chosen = [columns(number, c, n_features, p) for c in range(len(trees))]
    sizes = [len(of) * len(f) * p.bins for of, f in zip(live, chosen, strict=True)]

    def told(held):
        """A row for each node that has rows: gradients, Hessians and counts by feature and bin, as bytes."""
        for c, sums in enumerate(held):
            if sums is not None:
                by_node = np.stack(sums).reshape(3, len(live[c]), -1).transpose(1, 0, 2)
                used = np.flatnonzero(by_node[:, 2].any(1))
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), c, np.int32)), pa.array(np.array(live[c], np.int32)[used]), pa.array([by_node[i].tobytes() for i in used], pa.binary())], schema=_SUMS)

    def sums(batches):
        newest, trees, live = given.value
        held = [None] * len(trees)
        for b in batches:
            if not b.num_rows:
                continue
            ids, y, bins, m = _arrays(b)
            use = np.flatnonzero(sampled(ids, number, p))
            bins, y = bins[use], y[use]
            g, h = gradients(margins(m[use], newest, bins), y)
            for c, (tree, of, f) in enumerate(zip(trees, live, chosen, strict=True)):
                if not of:  # this class's tree is done while others still grow
                    continue
                slot = np.full(len(tree.feature), -1)
                slot[of] = np.arange(len(of))
                at = slot[nodes_of(tree, bins)]
                on = np.flatnonzero(at >= 0)
                cell = ((at[on, None] * len(f) + np.arange(len(f))) * p.bins + bins[on][:, f]).ravel()
                new = [np.bincount(cell, w, sizes[c]).astype(float) for w in (np.repeat(g[on, c], len(f)), np.repeat(h[on, c], len(f)), None)]
                held[c] = new if held[c] is None else [a + b for a, b in zip(held[c], new, strict=True)]
                if sum(sizes) > CELLS:
                    yield from told(held)
                    held[c] = None
        yield from told(held)

    def best(batches):
        for b in batches:
            for c, node, parts in zip(b["class"].to_pylist(), b["node"].to_pylist(), b["sums"], strict=True):
                f = chosen[c]
                g, h, n = sum(np.frombuffer(x.as_buffer(), float) for x in parts.values).reshape(3, len(f), p.bins)
                at, gain = best_bins(g, h, n, p)
                i = int(gain.argmax())  # of equal gains the first feature's
                left = [float(x[i, : at[i] + 1].sum()) for x in (g, h, n)]
                yield pa.RecordBatch.from_pylist([dict(zip(_BEST.names, (c, node, int(f[i]), int(at[i]), float(gain[i]), *left, *(float(x[i].sum()) for x in (g, h, n))), strict=True))], schema=_BEST)

    merged = rows.mapInArrow(sums, SUMS).groupBy("class", "node").agg(F.collect_list("sums").alias("sums"))  # one of each task
    return merged.mapInArrow(best, BEST).collect()


def grow(rows: DataFrame, newest: list[list[Growing]], number: int, classes: int, n_features: int, p: Boosting) -> list[Growing]:
    """One round's trees, a level of all of them at a time."""
    trees, live = [Growing() for _ in range(classes)], [[0] for _ in range(classes)]
    for depth in range(p.depth):
        found = level(rows, newest, trees, live, number, n_features, p)
        live = [[] for _ in range(classes)]
        for r in sorted(found, key=lambda r: (r["class"], r["node"])):
            tree = trees[r["class"]]
            if not depth:
                tree.g[0], tree.h[0], tree.n[0] = r["g"], r["h"], r["n"]
            if r["gain"] > p.least_gain:
                live[r["class"]] += tree.split(r["node"], r["feature"], r["bin"], r["gain"], (r["gl"], r["hl"], r["nl"]), (r["g"] - r["gl"], r["h"] - r["hl"], r["n"] - r["nl"]))
        if not any(live):
            break
    for tree in trees:
        value = -p.rate * shrunk(np.array(tree.g), p) / (np.array(tree.h) + p.l2)
        tree.value = np.where(np.array(tree.left) < 0, value, 0.0).tolist()
    return trees


def losses(rows: DataFrame, newest: list[list[Growing]]) -> list[float]:
    """Mean log loss after each of the newest rounds."""
    given = rows.sparkSession.sparkContext.broadcast(newest)

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, y, bins, m = _arrays(b)
                for i, of_round in enumerate(given.value):
                    m = margins(m, [of_round], bins)
                    loss = -np.log(np.maximum(shares(m)[np.arange(len(y)), y], 1e-15)).sum()
                    yield pa.RecordBatch.from_pydict({"i": [i], "loss": [loss], "n": [len(y)]}, pa.schema([("i", pa.int32()), ("loss", pa.float64()), ("n", pa.int64())]))

    out = rows.mapInArrow(run, "i int, loss double, n long").groupBy("i").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()
    return [r["loss"] for r in sorted(out, key=lambda r: r["i"])]


def moved(rows: DataFrame, newest: list[list[Growing]]) -> DataFrame:
    """Rows with the newest trees in their margins, stored."""
    given = rows.sparkSession.sparkContext.broadcast(newest)

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, _, bins, m = _arrays(b)
                yield pa.RecordBatch.from_arrays([b["id"], b["y"], b["bins"], pa.array(list(margins(m, given.value, bins)), pa.list_(pa.float64()))], schema=_ROWS)

    return stored(rows.mapInArrow(run, ROWS), "boosting")


@dataclass
class BoostedTrees:
    """Trees by round and class, the features' cut points, and the validation loss of each round that was tried."""

    trees: list[list[Growing]]
    cuts: list[np.ndarray]
    losses: list[float]

    @property
    def classes(self) -> int:
        return len(self.trees[0])

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1)
        return margins(np.zeros((len(x), self.classes)), self.trees, bins)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """pred and proba."""
        given = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def proba(x: pd.Series) -> pd.Series:
            return pd.Series(list(shares(given.value.margins(np.stack(x.to_list())))) if len(x) else [], dtype=object)

        out = rows.withColumn("proba", proba(F.transform(features, lambda v: v.cast("double"))))
        return out.withColumn("pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))

    def importances(self) -> np.ndarray:
        """Mean gain of each feature's splits, as shares of their sum."""
        gain, n = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for tree in (t for r in self.trees for t in r):
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    gain[f] += g
                    n[f] += 1
        mean = gain / np.maximum(n, 1)
        return mean / (mean.sum() or 1.0)


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The number of rounds up to the least error, and whether so many rounds without a lesser one have gone by."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit(rows: DataFrame, validation: DataFrame | None = None, p: Boosting = Boosting(), features: str = "features") -> BoostedTrees:  # noqa: B008
    """rows: y (0, 1, ...) and features. Where there are validation rows, training ends once ``patience`` rounds bring no lesser loss there."""
    if not 2 <= p.bins <= 256:
        raise ValueError(f"{p.bins} bins: 2 to 256")
    cuts = cut_points(rows, p, features)
    classes = int(rows.agg(F.max("y")).first()[0]) + 1
    train = stored(binned(rows, cuts, classes, features), "boosting")
    held = None if validation is None else stored(binned(validation, cuts, classes, features), "boosting")
    if held is not None and held.isEmpty():
        held = None
    trees, newest, seen = [], [], []
    for number in range(p.rounds):
        newest.append(grow(train, newest, number, classes, len(cuts), p))
        trees.append(newest[-1])
        if len(newest) == ROUNDS or number in (p.patience, p.rounds - 1):  # patience is the first round that can end it
            if held is not None:
                seen += losses(held, newest)
                if best_round(seen, p.patience)[1]:
                    break
            if number < p.rounds - 1:
                old = [t for t in (train, held) if t is not None]
                train, held = moved(train, newest), None if held is None else moved(held, newest)
                discard(*old)
                newest = []
    discard(*(t for t in (train, held) if t is not None))
    return BoostedTrees(trees[: best_round(seen, p.patience)[0]] if seen else trees, cuts, seen)
