"""Gradient-boosted regression trees for whole-number features, from one pass over the rows.

With the squared error, rows that agree in all features always get the same prediction, and all that
a split needs of them is how many there are and the sum of their targets. So Spark first sums the
rows into cells, by group (an era) and sampling share; every tree draws some of the shares. The
gradient sums of bins, nodes and trees are then sums over cells, of which there are as many as the
features have values, whatever the number of rows: one task per group grows the trees from them.
Targets are summed in whole millionths, so the trees don't depend on how rows are partitioned.

Leaves have an L2 term, rows and columns are sampled per tree. A model is a table with a row per
node, a node's children being 2n and 2n + 1; the row of tree 0 holds the mean all trees start from.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlake.functions.ordered import joined

#: Rows are dealt to so many sampling shares by an MD5 of their key.
SHARES = 20
#: Values of a feature: 0 up to one less than this; greater ones count as the last.
VALUES = {"TyreLife": 64, "LapNumber": 128, "Stint": 8}
OTHER_VALUES = 2
MILLIONTHS = 1_000_000
#: A split must gain more than this.
LEAST_GAIN = 1e-6

TREES = (
    "tree int, node int, feature string, threshold int, gain double, rows long, value double, "
    "features array<string>"
)


@dataclass(frozen=True)
class TreeParams:
    """Fixed values of the published model."""

    trees: int = 300
    rate: float = 0.05
    depth: int = 5
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_rows: int = 1
    seed: int = 42


def _value(name: str) -> Column:
    most = VALUES.get(name, OTHER_VALUES) - 1
    return F.greatest(F.lit(0), F.least(F.lit(most), F.col(name).cast("int"))).alias(name)


def share_of(key: list[str], seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit("share"), F.lit(seed), *key))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SHARES).cast("int")


def cells(
    rows: DataFrame, features: list[str], target: str, by: list[str], key: list[str], seed: int = 42
) -> DataFrame:
    """(by, features, share, rows, total): number and sum of targets, in millionths, of the rows
    that agree in the group, all features and the share. Rows with a null feature or target are
    left out."""
    named = rows.dropna(subset=[*features, target]).select(
        *by, *[_value(name) for name in features], share_of(key, seed).alias("share"),
        F.round(F.col(target) * MILLIONTHS).cast("long").alias("_target"),
    )
    return named.groupBy(*by, *features, "share").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_target").alias("total")
    )


# --- growing ------------------------------------------------------------------------------------


def _best_splits(values, columns, place, nodes, g, h, params):
    """Per node the best (gain, column, threshold); ties go to the first column and threshold."""
    gain = np.full(nodes, LEAST_GAIN)
    column, threshold = np.full(nodes, -1), np.zeros(nodes, np.int64)
    all_g, all_h = np.bincount(place, g, nodes)[:, None], np.bincount(place, h, nodes)[:, None]
    whole = all_g**2 / (all_h + params.l2)
    for j in columns:
        width = int(values[:, j].max()) + 1
        at = place * width + values[:, j]
        left_g = np.cumsum(np.bincount(at, g, nodes * width).reshape(nodes, width), axis=1)[:, :-1]
        left_h = np.cumsum(np.bincount(at, h, nodes * width).reshape(nodes, width), axis=1)[:, :-1]
        right_g, right_h = all_g - left_g, all_h - left_h
        both = left_g**2 / (left_h + params.l2) + right_g**2 / (right_h + params.l2) - whole
        both[(left_h < params.least_rows) | (right_h < params.least_rows)] = -np.inf
        if width > 1:
            first = both.argmax(axis=1)
            top = both[np.arange(nodes), first]
            better = top > gain * (1 + 1e-12)
            gain[better], column[better], threshold[better] = top[better], j, first[better]
    return gain, column, threshold


def grown(values: np.ndarray, rows: np.ndarray, total: np.ndarray, params: TreeParams) -> list[tuple]:
    """(tree, node, column, threshold, gain, rows, value) of all trees. `values` has a row per cell
    and a column per feature; `rows` and `total` a column per share. Column -1: a leaf."""
    n_cells, n_columns = values.shape
    mean = total.sum() / MILLIONTHS / rows.sum()
    out: list[tuple] = [(0, 1, -1, 0, 0.0, int(rows.sum()), float(mean))]
    predicted = np.full(n_cells, mean)
    n_shares = max(1, round(params.row_share * SHARES))
    taken = max(1, int(params.column_share * n_columns))
    for tree in range(1, params.trees + 1):
        random = np.random.default_rng([params.seed, tree])
        shares = random.permutation(SHARES)[:n_shares]
        columns = np.sort(random.permutation(n_columns)[:taken])
        h = rows[:, shares].sum(1).astype(float)
        g = h * predicted - total[:, shares].sum(1) / MILLIONTHS
        node, change = np.ones(n_cells, np.int64), np.zeros(n_cells)
        open_cells = np.arange(n_cells)
        for depth in range(params.depth + 1):
            names, place = np.unique(node[open_cells], return_inverse=True)
            cell_g, cell_h = g[open_cells], h[open_cells]
            if depth < params.depth:
                gain, column, threshold = _best_splits(
                    values[open_cells], columns, place, len(names), cell_g, cell_h, params
                )
            else:
                gain, column, threshold = np.zeros(len(names)), np.full(len(names), -1), np.zeros(len(names))
            sum_g, sum_h = np.bincount(place, cell_g), np.bincount(place, cell_h)
            value = np.where(column < 0, -params.rate * sum_g / (sum_h + params.l2), 0.0)
            for k, name in enumerate(names):
                numbers = float(gain[k]) if column[k] >= 0 else 0.0, int(sum_h[k]), float(value[k])
                out.append((tree, int(name), int(column[k]), int(threshold[k]), *numbers))
            closed = column[place] < 0
            change[open_cells[closed]] = value[place[closed]]
            open_cells, place = open_cells[~closed], place[~closed]
            if not len(open_cells):
                break
            right = values[open_cells, column[place]] > threshold[place]
            node[open_cells] = 2 * node[open_cells] + right
        predicted += change
    return out


def _grow(by: list[str], features: list[str], params: TreeParams):
    def of_group(table: pa.Table) -> pa.Table:
        columns = np.stack([table[name].to_numpy() for name in features], axis=1)
        values, place = np.unique(columns, axis=0, return_inverse=True)
        share = table["share"].to_numpy()
        rows, total = np.zeros((len(values), SHARES)), np.zeros((len(values), SHARES))
        rows[place.ravel(), share] = table["rows"].to_numpy()
        total[place.ravel(), share] = table["total"].to_numpy()
        tree, node, column, threshold, gain, count, value = zip(
            *grown(values, rows, total, params), strict=True
        )
        made = {name: table[name].take(pa.array([0] * len(tree))) for name in by}
        inner = [c >= 0 for c in column]
        made |= {
            "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int32()),
            "feature": pa.array(
                [features[c] if split else None for c, split in zip(column, inner, strict=True)], pa.string()
            ),
            "threshold": pa.array(
                [t if split else None for t, split in zip(threshold, inner, strict=True)], pa.int32()
            ),
            "gain": pa.array(gain), "rows": pa.array(count, pa.int64()), "value": pa.array(value),
            "features": pa.array([features if t == 0 else None for t in tree], pa.list_(pa.string())),
        }
        return pa.table(made)

    return of_group


def fit(cell_rows: DataFrame, features: list[str], by: list[str], params: TreeParams) -> DataFrame:
    """The trees of each group, as a table. A group's cells, which the values of the features bound,
    meet in a task."""
    kinds = {field.name: field.dataType.simpleString() for field in cell_rows.schema}
    schema = ", ".join([*[f"`{name}` {kinds[name]}" for name in by], TREES])
    return cell_rows.groupBy(*by).applyInArrow(_grow(by, features, params), schema)


# --- using ----------------------------------------------------------------------------------------


class Forest:
    """The trees of one group as arrays with a row per tree, to score many rows at once."""

    def __init__(self, nodes: list, features: list[str]):
        self.features = features
        n_trees = 1 + max(node.tree for node in nodes)
        width = 1 + max(node.node for node in nodes)
        self.column = np.full((n_trees, width), -1)
        self.threshold, self.value = np.zeros((n_trees, width)), np.zeros((n_trees, width))
        for x in nodes:
            self.value[x.tree, x.node] = x.value
            if x.feature is not None:
                self.column[x.tree, x.node] = features.index(x.feature)
                self.threshold[x.tree, x.node] = x.threshold

    def score(self, rows: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.column))
        node = np.ones((len(rows), len(tree)), np.int64)
        while True:
            column = self.column[tree, node]
            inner = column >= 0
            if not inner.any():
                return self.value[tree, node].sum(1)
            right = np.take_along_axis(rows, np.maximum(column, 0), 1) > self.threshold[tree, node]
            node = np.where(inner, 2 * node + right, node)


@dataclass(frozen=True)
class BoostedTrees:
    """Fitted trees: the table of their nodes, and the columns that name its groups."""

    trees: DataFrame
    by: list[str]

    def roots(self) -> list:
        """A row per group, with the features: as many as there are groups (eras)."""
        return self.trees.where("tree = 0").orderBy(*self.by).collect()

    @property
    def features(self) -> list[str]:
        return self.roots()[0].features

    def forests(self) -> dict[tuple, Forest]:
        """The forests by group. A forest has at most 2 ** (depth + 1) nodes a tree."""
        features, nodes = {}, {}
        for row in self.trees.collect():
            group = tuple(row[name] for name in self.by)
            nodes.setdefault(group, []).append(row)
            if row.tree == 0:
                features[group] = row.features
        return {group: Forest(rows, features[group]) for group, rows in nodes.items()}

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`, null where a feature is null or the group has no trees. Every
        different combination of features is scored once."""
        forests, by, features = self.forests(), self.by, self.features
        keys = [*by, *features]
        fields = [rows.schema[name] for name in keys]

        def score(batches):
            for batch in batches:
                groups = list(zip(*[batch.column(name).to_pylist() for name in by], strict=True))
                groups = groups or [()] * batch.num_rows
                values = np.stack([batch.column(n).cast(pa.float64()).to_numpy(False) for n in features], 1)
                out = np.full(batch.num_rows, np.nan)
                for group in set(groups) & forests.keys():
                    mine = np.array([x == group for x in groups])
                    for at in np.array_split(np.flatnonzero(mine), 1 + mine.sum() // 2000):
                        out[at] = forests[group].score(values[at])
                columns = [*batch.columns, pa.array(out, mask=np.isnan(out))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "prediction"])

        schema = T.StructType([*fields, T.StructField("prediction", T.DoubleType())])
        different = rows.select(*keys).dropna(subset=features).distinct()
        return joined(rows, different.mapInArrow(score, schema), keys)

    def importances(self) -> DataFrame:
        """(by, feature, importance): mean gain of a feature's splits as a share of all features'
        mean gains, with four decimals; 0 for a feature without splits."""
        names = self.trees.where("tree = 0").select(*self.by, F.explode("features").alias("feature"))
        gains = (
            self.trees.where("feature IS NOT NULL").groupBy(*self.by, "feature").agg(F.avg("gain").alias("_gain"))
        )
        whole = gains.groupBy(*self.by).agg(F.sum("_gain").alias("_all"))
        named = joined(joined(names, gains, [*self.by, "feature"]), whole, self.by)
        share = F.coalesce(F.col("_gain") / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0))
        return named.select(*self.by, "feature", F.round(share, 4).alias("importance"))
