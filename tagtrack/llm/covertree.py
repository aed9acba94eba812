"""Hard negatives by inner product, found with cover trees over norm-augmented candidates.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2), so that all candidates of a
tree lie on one sphere of radius M and a query (q, 0) has the same inner product with
them. On that sphere angles are a metric: a node holds a centre, which is one of its own rows, and
the largest angle of any row below it (its covering radius), so with phi the angle of query and
centre every score below lies between |q| M cos(phi + radius) and |q| M cos(phi - radius).

A tree is a table of rows in tree order with one number each, ``split``: the first level on
which a node begins at the row. The rows of a node are then one run, and its centre is the first of them. Levels
halve the angle (``SCALES``): within a node the next centres are more than the scale apart, and every row is within it of its centre.

The descent is best-first: nodes are opened in the order of the best score they can hold within a
window, nodes whose bounds lie outside all windows of the query, or below the worst of the
best found, are never opened, and rows of leaves are scored exactly. Candidates are dealt
over *strips*, tables that fit a task, which hold some trees each; queries meet every strip,
in groups, and the best of each strip are merged. So a task holds one strip and one group of queries, whatever the table.

Defined results: rows with a NULL id, label or vector, or NULL or non-finite components take no part; vectors
of different lengths are not compared; equal scores come by smaller id; repeated rows are rows of their own (an anchor's twin is another row); an anchor
without positives, or a positive without negatives in its window, gives no row; other columns play no part.
Scores are exact up to 2**53, NULL beyond 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack.llm.common import saved

#: rows of a tree, rows of a leaf that are not split further, nodes opened at once, queries of a group
TREE, LEAF, OPEN, GROUP = 4096, 16, 64, 8192
#: trees of a strip grow with the table, from 2 to 16
FEW, MANY = 2, 16
SCALES = [math.pi / 2 ** (k + 1) for k in range(10)]
INSIDE = len(SCALES) + 1  # split of a row at which no node begins
SLACK = 1e-6


def lifted(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Norm-augmented rows, on the unit sphere, and M."""
    norm = np.linalg.norm(x, axis=1)
    m = float(norm.max(initial=0.0)) or 1.0
    x = x / m
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]), m


def _net(y: np.ndarray, rows: np.ndarray, scale: float) -> list[np.ndarray]:
    """``rows`` shared out among centres more than ``scale`` apart, each first in its part; the first row is a centre."""
    bar, parts, rest = math.cos(scale), [], rows
    left = y[rows]
    while len(rest):
        near = left @ left[0] >= bar
        near[0] = True
        parts.append(rest[near])
        rest, left = rest[~near], left[~near]
    return parts


def planted(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree order of the rows, and the level on which a node begins at each."""
    order, split = [], []
    todo = [(np.arange(len(y)), 0, 0)]  # rows, level of their node, first level on which it begins
    while todo:
        rows, level, begins = todo.pop()
        if len(rows) <= LEAF or level == len(SCALES):
            order.append(rows)
            split.append(np.concatenate([[begins], np.full(len(rows) - 1, INSIDE)]))
            continue
        parts = _net(y, rows, SCALES[level])
        for k, part in reversed(list(enumerate(parts))):  # the first part comes off the stack first
            todo.append((part, level + 1, level + 1 if k else begins))
    return np.concatenate(order), np.concatenate(split).astype(np.int32)


@dataclass
class Forest:
    """The trees of a strip, ready for queries: rows in tree order and nodes as runs of them."""

    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray  # of the children, none for a leaf
    last: np.ndarray
    roots: np.ndarray
    lifted: np.ndarray
    size: np.ndarray  # M of the tree, by row

    @classmethod
    def of(cls, trees: list[pd.DataFrame]) -> Forest:
        runs: list[list[np.ndarray]] = [[] for _ in range(5)]
        roots, ups, sizes, xs = [], [], [], []
        row = node = 0
        for t in trees:
            x, split = np.stack(t["x"].to_numpy()).astype(float), t["split"].to_numpy()
            y, m = lifted(x)
            n, levels = len(x), []
            for level in range(len(SCALES) + 1):
                starts = np.flatnonzero(split <= level)
                lens = np.diff(np.append(starts, n))
                cos = np.clip(np.einsum("ij,ij->i", y, y[np.repeat(starts, lens)]), -1, 1)
                levels.append((starts, starts + lens, np.maximum.reduceat(np.arccos(cos), starts)))
                if level and len(starts) == np.count_nonzero(split < INSIDE):
                    break  # every node has begun
            sums = np.cumsum([0] + [len(s) for s, _, _ in levels])
            below = (np.zeros(len(levels[-1][0]), int), np.zeros(len(levels[-1][0]), int))
            kids = [below]
            for k in range(len(levels) - 2, -1, -1):
                starts, ends, _ = levels[k]
                a = np.searchsorted(levels[k + 1][0], starts)
                b = np.searchsorted(levels[k + 1][0], ends)
                same = b - a == 1  # not split on the next level: its children are that node's
                own = a + sums[k + 1] + node, b + sums[k + 1] + node
                below = tuple(np.where(same, low[np.minimum(a, len(low) - 1)], mine) for low, mine in zip(below, own, strict=True))
                kids.append(below)
            kids.reverse()
            for out, columns in zip(runs, ([s + row for s, _, _ in levels], [e + row for _, e, _ in levels], [r for _, _, r in levels], [k[0] for k in kids], [k[1] for k in kids]), strict=True):
                out.extend(columns)
            roots.append(node)
            ups.append(y)
            sizes.append(np.full(n, m))
            xs.append(x)
            row, node = row + n, node + int(sums[-1])
        rows = pd.concat(trees)
        start, end, radius, first, last = (np.concatenate(r) for r in runs)
        return cls(
            rows["id"].to_numpy(), rows["label"].to_numpy(), rows["r"].to_numpy(), np.concatenate(xs),
            start, end, radius, first, last, np.array(roots), np.concatenate(ups), np.concatenate(sizes),
        )

    def best(self, q: np.ndarray, label: int, number: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the best ``k`` rows of the same (or another) label for every window [low, high], best first."""
        norm = float(np.linalg.norm(q))
        found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in low]
        bar = low.astype(float).copy()  # what a row must reach: the window's end, or the worst of the best k
        pool, top, bottom = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        nodes = self.roots
        while True:
            if len(nodes):
                c, m = self.start[nodes], self.size[self.start[nodes]] * norm
                phi = np.arccos(np.clip(self.lifted[c, :-1] @ q / (norm or 1.0), -1, 1))
                r = self.radius[nodes]
                pool = np.concatenate([pool, nodes])
                top = np.concatenate([top, m * (np.cos(np.maximum(phi - r, 0)) + SLACK)])
                bottom = np.concatenate([bottom, m * (np.cos(np.minimum(phi + r, math.pi)) - SLACK)])
            reach = np.minimum(top[:, None], high[None, :])
            reach = np.where((bottom[:, None] <= high) & (reach >= bar), reach, -np.inf).max(axis=1)
            alive = reach > -np.inf
            pool, top, bottom, reach = pool[alive], top[alive], bottom[alive], reach[alive]
            if not len(pool):
                return found
            if len(pool) > OPEN:
                at = np.argpartition(-reach, OPEN - 1)
                take, keep = at[:OPEN], at[OPEN:]
            else:
                take, keep = np.arange(len(pool)), np.zeros(0, int)
            opened = pool[take]
            pool, top, bottom = pool[keep], top[keep], bottom[keep]
            leaf = self.last[opened] == self.first[opened]
            inner = opened[~leaf]
            nodes = _ranges(self.first[inner], self.last[inner])
            rows = _ranges(self.start[opened[leaf]], self.end[opened[leaf]])
            rows = rows[((self.labels[rows] == label) == same) & (self.numbers[rows] != number)]
            if not len(rows):
                continue
            scores, ids = self.x[rows] @ q, self.ids[rows]
            for w in range(len(low)):
                fits = (scores >= bar[w]) & (scores <= high[w])
                if fits.any():
                    s, i = np.concatenate([found[w][0], scores[fits]]), np.concatenate([found[w][1], ids[fits]])
                    order = np.lexsort((i, -s))[:k]
                    found[w] = s[order], i[order]
                    if len(order) == k:
                        bar[w] = max(bar[w], s[order[-1]])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    many = last - first
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


TREES = "strip int, tree int, place int, r long, id long, label long, x array<double>, split int"


def _planted(part: pd.DataFrame) -> pd.DataFrame:
    out = []
    part = part.sort_values("r")
    for k, at in enumerate(range(0, len(part), TREE)):
        t = part.iloc[at : at + TREE]
        order, split = planted(lifted(np.stack(t["x"].to_numpy()).astype(float))[0])
        out.append(t.iloc[order].assign(tree=k, place=np.arange(len(t)), split=split))
    return pd.concat(out)[[f.split()[0] for f in TREES.split(", ")]]


def trees(rows: DataFrame) -> tuple[DataFrame, int]:
    """The candidates (r, id, label, x) as written trees, and the number of strips."""
    n = rows.count()
    wide = TREE * min(MANY, max(FEW, n // (TREE * 256)))
    strips = max(1, math.ceil(n / wide))
    dealt = rows.withColumn("strip", F.pmod(F.xxhash64("r"), F.lit(strips)).cast("int"))
    return saved(dealt.groupBy("strip").applyInPandas(_planted, TREES), "trees"), strips


def searched(planted_rows: DataFrame, strips: int, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """ask, w, rank, id, score: the best ``k`` rows of every window w of every ask (ask, label, x, low, high)."""
    groups = max(1, math.ceil(asks.count() / GROUP))
    group = F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int")
    left = planted_rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asks.withColumn("g", group).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            forest = Forest.of([t for _, t in rows.sort_values(["tree", "place"]).groupby("tree", sort=True)])
            for a, label, x, low, high in zip(*(queries[c] for c in ("ask", "label", "x", "low", "high")), strict=True):
                found = forest.best(np.asarray(x, float), label, a, same, np.asarray(low, float), np.asarray(high, float), k)
                out += [(a, w, i, s) for w, (scores, ids) in enumerate(found) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["ask", "w", "id", "score"]).astype({"ask": "int64", "w": "int32", "id": "int64", "score": "float64"})

    found = left.groupBy("strip", "g").cogroup(right.groupBy("strip", "g")).applyInPandas(search, "ask long, w int, id long, score double")
    best = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("ask", "w", "rank", "id", F.col("score").try_cast("long").alias("score"))


def _finite(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(fine, F.lit(False))


def steps(x: Column, per_one: int = 256) -> Column:
    """floor(per_one * x) as a double, NaN and infinities as they are."""
    y = x.cast("double") * per_one
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


def mined(
    df: DataFrame, id: str, label: Column, vector: Column, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The first ``positives`` rows of the anchor's label are its positives; for each, the first ``negatives``
    rows of other labels that score ``low`` to ``high`` percent of the positive.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), label.cast("long").alias("label"), vector.alias("x"), anchor.alias("a"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & _finite(F.col("x")) & (F.size("x") > 0))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("r"), "id", "label", "x", "a"), "candidates")
    out = None
    for d in sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect()):
        part = _mined(rows.where(F.size("x") == d), positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], empty)
    return out


def _mined(rows: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    planted_rows, strips = trees(rows.drop("a"))
    anchors = rows.where("a").select(F.col("r").alias("ask"), "id", "label", "x")
    every = F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high")
    good = searched(planted_rows, strips, anchors.select("ask", "label", "x", *every), True, positives)
    good = saved(good.select("ask", "rank", "id", "score"), "positives")
    score = F.transform("p", lambda p: p["score"].cast("double"))
    windows = good.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    windows = windows.select("ask", F.transform(score, lambda s: s * low / 100).alias("low"), F.transform(score, lambda s: s * high / 100).alias("high"))
    found = searched(planted_rows, strips, anchors.select("ask", "label", "x").join(windows, "ask"), False, negatives)
    named = good.join(anchors.select("ask", F.col("id").alias("anchor_id")), "ask")
    named = named.select("ask", (F.col("rank") - 1).alias("w"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["ask", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
