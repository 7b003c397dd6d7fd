"""t-SNE for all rows: an exact layout of landmarks, the other rows placed among them, then moves of all rows together.

Attraction goes along a graph of nearest neighbours: edges joined with positions, summed by row. Repulsion between all rows
is interpolated: tasks spread their rows' charges over the nodes of a grid, the driver convolves the grid with the kernels,
and tasks read the forces off at their rows' positions. The grid has at most (3 * SIDE)^2 nodes, however many rows there
are. Positions are stored after every move; edges are stored once, in buckets of one end, so that a move shuffles them by the other only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import dealt, discard, stored

#: Neighbours that attract a row, moves of all rows, boxes along a side of the grid (of width 1/2, if they are enough), landmarks that place another row.
NEAR, MOVES, SIDE, PLACING = 30, 15, 200, 3


def conditional(d2: np.ndarray, row: np.ndarray, rows: int, perplexity: float) -> np.ndarray:
    """Each row's shares exp(-beta d^2), beta such that their perplexity is the one given, or nine tenths of the neighbours if they are fewer."""
    least = np.full(rows, np.inf)
    np.minimum.at(least, row, d2)
    over, count = d2 - least[row], np.maximum(np.bincount(row, minlength=rows), 1)
    target = np.log(np.maximum(np.minimum(perplexity, 0.9 * count), 1))
    beta = 1 / np.maximum(np.bincount(row, over, rows) / count, 1e-12)
    low, high = np.zeros(rows), np.full(rows, np.inf)
    for _ in range(60):
        w = np.exp(-beta[row] * over)
        s = np.maximum(np.bincount(row, w, rows), 1e-300)
        much = np.log(s) + beta * np.bincount(row, w * over, rows) / s > target
        low, high = np.where(much, beta, low), np.where(much, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    return w / s[row]


def exact(x: list, perplexity: float, rounds: int, seed: int = 42) -> np.ndarray:
    """Places of a few rows, by gradient descent over all pairs."""
    x = np.array(x)
    n = len(x)
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    x2 = (x * x).sum(1)
    d2 = np.maximum(x2[:, None] + x2 - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    p[i, j] = conditional(d2[i, j], i, n, perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    r = np.random.default_rng(seed)
    y, step = r.normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        y2 = (y * y).sum(1)
        num = 1 / (1 + np.maximum(y2[:, None] + y2 - 2 * y @ y.T, 0))
        np.fill_diagonal(num, 0)
        g = (p * (4 if t < 100 else 1) - np.maximum(num / num.sum(), 1e-12)) * num
        step = (0.5 if t < 100 else 0.8) * step - max(n / 12, 50) * 4 * (g.sum(1)[:, None] * y - g @ y)
        y = y + step
        y = y - y.mean(0)
    return y


def placed(rows: DataFrame, x: list, places: np.ndarray) -> DataFrame:
    """id, u, v: the mean of the nearest landmarks' places, weighed by inverse squared distances; a landmark stays where it is. rows: id, x."""
    given = rows.sparkSession.sparkContext.broadcast((np.array(x), places))

    def place(batches):
        marks, places = given.value
        m2, few = (marks * marks).sum(1), min(PLACING, len(marks))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b["x"].to_numpy(zero_copy_only=False))
            d2 = np.maximum((x * x).sum(1)[:, None] + m2 - 2 * x @ marks.T, 0)
            at = np.argpartition(d2, few - 1, 1)[:, :few]
            w = 1 / np.maximum(np.take_along_axis(d2, at, 1), max(1e-9 * d2.mean(), 1e-300))
            y = (w[:, :, None] * places[at]).sum(1) / w.sum(1)[:, None]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(y[:, 0]), pa.array(y[:, 1])], ["id", "u", "v"])

    return rows.select("id", "x").mapInArrow(place, "id long, u double, v double")


def affinities(near: DataFrame, n: int, perplexity: float) -> DataFrame:
    """id, other, p, in both directions: shares of both ends' neighbours, which add up to one over all rows. near: id, other, d."""

    def weigh(batches):
        for b in batches:
            if b.num_rows:
                lists = b["near"]
                row, flat = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
                p = conditional(flat.field("d").to_numpy() ** 2, row, b.num_rows, perplexity)
                yield pa.RecordBatch.from_arrays([pa.array(b["id"].to_numpy()[row]), flat.field("other"), pa.array(p / (2 * n))], ["id", "other", "p"])

    one = near.groupBy("id").agg(F.collect_list(F.struct("other", "d")).alias("near")).mapInArrow(weigh, "id long, other long, p double")  # NEAR of each
    return one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "p")).groupBy("id", "other").agg(F.sum("p").alias("p"))


class Repulsion:
    """What pushes rows apart, from charges summed on a grid of ``boxes`` by ``boxes`` boxes with three by three nodes each."""

    def __init__(self, low: tuple[float, float], span: float):
        self.low, self.boxes = np.array(low), int(np.clip(np.ceil(2 * span), 20, SIDE))
        self.width, self.nodes = max(span, 1e-9) / self.boxes, 3 * self.boxes

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and their weights at each position, nine of each: parabolas through the three nodes along either side."""
        at = (y - self.low) / self.width
        box = np.clip(np.floor(at), 0, self.boxes - 1)
        s = (at - box) * 3 - 1.5
        side = np.stack([s * (s - 1) / 2, 1 - s * s, s * (s + 1) / 2], 2)
        node = (3 * box).astype(np.int64)[:, :, None] + np.arange(3)
        return (node[:, 0, :, None] * self.nodes + node[:, 1, None, :]).reshape(-1, 9), (side[:, 0, :, None] * side[:, 1, None, :]).reshape(-1, 9)

    def charges(self, where: DataFrame) -> np.ndarray:
        """Rows, their u and their v, spread over the nodes."""

        def spread(batches):
            total = np.zeros((3, self.nodes**2))
            for b in batches:
                y = np.stack([b["u"].to_numpy(), b["v"].to_numpy()], 1)
                node, w = self.weights(y)
                for c, q in enumerate((np.ones(len(y)), y[:, 0], y[:, 1])):
                    total[c] += np.bincount(node.ravel(), (w * q[:, None]).ravel(), total.shape[1])
            used = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in total)], ["node", "q", "qu", "qv"])

        parts = where.select("u", "v").mapInArrow(spread, "node long, q double, qu double, qv double")
        got = parts.groupBy("node").agg(F.sum("q").alias("q"), F.sum("qu").alias("qu"), F.sum("qv").alias("qv")).toPandas()  # a row for each node at most
        out = np.zeros((3, self.nodes**2))
        out[:, got["node"].to_numpy()] = got[["q", "qu", "qv"]].to_numpy().T
        return out

    def solve(self, charges: np.ndarray, n: int) -> Repulsion:
        """Convolves the charges with 1 / (1 + d^2), which gives the normaliser, and with its square, which gives the forces."""
        m = self.nodes
        steps = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * (self.width / 3)
        near = 1 / (1 + steps[:, None] ** 2 + steps**2)
        grid = charges.reshape(3, m, m)
        spectrum = np.fft.rfft2(grid, (2 * m, 2 * m))
        back = lambda k, f: np.fft.irfft2(np.fft.rfft2(k) * f, (2 * m, 2 * m))[..., :m, :m]
        self.normaliser = max(float((grid[0] * back(near, spectrum[0])).sum()) - n, 1e-12)
        self.fields = back(near**2, spectrum).reshape(3, -1)
        return self

    def at(self, y: np.ndarray) -> np.ndarray:
        """The sum over all rows of (y - theirs) / (1 + d^2)^2, over the normaliser."""
        node, w = self.weights(y)
        q, qu, qv = ((f[node] * w).sum(1) for f in self.fields)
        return (y * q[:, None] - np.stack([qu, qv], 1)) / self.normaliser


def repulsion(where: DataFrame, n: int) -> Repulsion:
    """Of all rows at their places. where: u, v."""
    b = where.agg(F.min("u"), F.min("v"), F.max("u"), F.max("v")).first()
    r = Repulsion((b[0], b[1]), max(b[2] - b[0], b[3] - b[1]))
    return r.solve(r.charges(where), n)


def moved(start: DataFrame, affinities: DataFrame, n: int, moves: int = MOVES) -> DataFrame:
    """id, u, v after so many moves down the gradient, with half of the last move added. start: id, u, v."""
    rate = n / 3
    ties = dealt(affinities, "tsne-ties", "other")
    where = stored(start.select("id", "u", "v", F.lit(0.0).alias("du"), F.lit(0.0).alias("dv")), "tsne")
    for _ in range(moves):
        given = where.sparkSession.sparkContext.broadcast(repulsion(where, n))

        def move(batches, given=given):
            for b in batches:
                if not b.num_rows:
                    continue
                y, d, pull = (np.stack([b[c].to_numpy() for c in cs], 1) for cs in (("u", "v"), ("du", "dv"), ("pu", "pv")))
                d = 0.5 * d + rate * (given.value.at(y) - pull)
                y = y + d
                yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(a[:, c]) for a in (y, d) for c in (0, 1))], ["id", "u", "v", "du", "dv"])

        both = ties.join(where.select(F.col("id").alias("other"), F.col("u").alias("ou"), F.col("v").alias("ov")), "other").join(where.select("id", "u", "v"), "id")
        share = F.col("p") / (1 + (F.col("u") - F.col("ou")) ** 2 + (F.col("v") - F.col("ov")) ** 2)
        pulls = both.groupBy("id").agg(F.sum(share * (F.col("u") - F.col("ou"))).alias("pu"), F.sum(share * (F.col("v") - F.col("ov"))).alias("pv"))
        next_ = where.join(pulls, "id", "left").fillna(0.0, ["pu", "pv"]).mapInArrow(move, "id long, u double, v double, du double, dv double")
        old, where = where, stored(next_, "tsne")
        discard(old)
    discard(ties)
    return where.select("id", "u", "v")
