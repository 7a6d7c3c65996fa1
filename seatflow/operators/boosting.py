"""Boosted regression trees on binned rows: the trees of MLlib, grown over arrays of bins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.session import fresh_path, use_checkpoints

#: Rows that are counted at a time, so that their indexes stay in the cache of a core.
STEP = 65_536
#: Features of few bins share a column as long as their bins multiply to no more.
COLUMN_BINS = 2048
#: The histograms of more tasks than this are added up on the executors.
MANY_TASKS = 256
#: One task grows all trees of so many rows sooner than the jobs of their levels would start.
ONE_TASK_ROWS = 500_000
LEAST_IMPURITY = 2.0**-52
ALL_FEATURES = ("all", "auto")
TREE_PARAMS = (
    "cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
    "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed",
)
NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
    "leftChild int, rightChild int, "
    "split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


# --- bins -----------------------------------------------------------------------------------


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """Where a number feature is cut: between all its values, or else ``most`` times after about
    as many rows each, at the places MLlib takes."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) <= most:
        return between
    stride, seen = len(values) / (most + 1), np.cumsum(counts)
    cuts, target = [], stride
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            cuts.append(between[i - 1])
            target += stride
    return np.array(cuts)


@dataclass(frozen=True)
class Layout:
    """How the features lie in columns of bins. ``cuts`` holds None for a category feature."""

    cuts: list[np.ndarray | None]
    bins: list[int]
    columns: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        """First fit, widest first; a feature of one bin can split nothing and has no column."""
        widths: list[int] = []
        for f in sorted(range(len(self.bins)), key=lambda f: -self.bins[f]):
            n = self.bins[f]
            if n < 2:
                continue
            at = next((c for c, w in enumerate(widths) if w * n <= COLUMN_BINS), len(widths))
            if at == len(widths):
                widths.append(1)
                self.columns.append([])
            widths[at] *= n
            self.columns[at].append(f)

    def width(self, c: int) -> int:
        return int(np.prod([self.bins[f] for f in self.columns[c]]))

    def place(self, f: int) -> tuple[int, np.ndarray]:
        """The column of a feature, and the feature's bin for each value of the column."""
        c = next(c for c, fs in enumerate(self.columns) if f in fs)
        shape = [self.bins[g] for g in self.columns[c]]
        return c, np.indices(shape)[self.columns[c].index(f)].ravel()

    def binned(self, features: np.ndarray) -> list[np.ndarray]:
        """Columns of bins of rows of features."""
        out = []
        for c, fs in enumerate(self.columns):
            value = np.zeros(len(features), np.int64)
            for f in fs:
                at = features[:, f]
                own = at.astype(np.int64) if self.cuts[f] is None else np.searchsorted(self.cuts[f], at)
                if self.cuts[f] is None and len(own) and not 0 <= own.min() <= own.max() < self.bins[f]:
                    raise ValueError(f"feature {f} has a category that is not one of {self.bins[f]}")
                value = value * self.bins[f] + own
            out.append(value.astype(np.min_scalar_type(self.width(c) - 1)))
        return out

    def by_feature(self, c: int, table: np.ndarray) -> list[np.ndarray]:
        """Sums per node and value of a column as sums per node and bin of each feature in it."""
        cube = table.reshape(*table.shape[:-1], *[self.bins[f] for f in self.columns[c]])
        axes = range(table.ndim - 1, cube.ndim)
        return [cube.sum(axis=tuple(a for a in axes if a != own)) for own in axes]

    def place_kind(self, depth: int) -> np.dtype:
        """Numbers for the places in a table (node, value) at this depth; small ones are quick."""
        most = (2**depth + 1) * max([1, *map(self.width, range(len(self.columns)))])
        return np.min_scalar_type(most)


# --- in the tasks ---------------------------------------------------------------------------

#: Rows of a task: columns of bins, what is left to explain, and the sums of squares of the last leaves.
Rows = tuple[list[np.ndarray], np.ndarray, np.ndarray | None]
#: A level of a tree: per column that splits a node the table (node, value) -> next node.
Level = list[tuple[int, np.ndarray]]


def _sampled(n: int, share: float, seed: tuple[int, ...]) -> np.ndarray:
    return np.random.Generator(np.random.SFC64(seed)).random(n, dtype=np.float32) < share


def _places(columns: list[np.ndarray], at: slice, node: np.ndarray, c: int, width: int) -> np.ndarray:
    """Where the rows lie in a table (node, value) of a column."""
    place = node * node.dtype.type(width)
    place += columns[c][at]
    return place.astype(np.intp)


def _walked(columns: list[np.ndarray], at: slice, node: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The node of each row below these levels."""
    for tables in levels:
        following = None
        for c, table in tables:
            found = table.ravel().take(_places(columns, at, node, c, table.shape[1]))
            following = found if following is None else following + found
        node = following
    return node


def _figures(
    rows: Rows, levels: list[Level], n_nodes: int, layout: Layout, kept: np.ndarray, kind: np.dtype
) -> list[np.ndarray]:
    """Per node count, sum, sum of squares; then counts and sums per node and bin of each feature."""
    columns, left, _ = rows
    widths = [layout.width(c) for c in range(len(columns))]
    own = np.zeros((3, n_nodes + 1))
    tables = [np.zeros((2, (n_nodes + 1) * w)) for w in widths]
    for start in range(0, len(left), STEP):
        at = slice(start, min(start + STEP, len(left)))
        # The tree starts at node 0, and rows that it does not look at stay behind the last node.
        y, node = left[at], _walked(columns, at, (~kept[at]).astype(kind), levels)
        for power in range(2 if columns else 0, 3):
            own[power] += np.bincount(node, y**power if power else None, n_nodes + 1)
        for c, (table, width) in enumerate(zip(tables, widths, strict=True)):
            place = _places(columns, at, node, c, width)
            for i, weights in enumerate((None, y)):
                table[i] += np.bincount(place, weights, table.shape[1])
    of = [t.reshape(2, n_nodes + 1, -1)[:, :-1] for t in tables]
    own = own[:, :-1]
    if of:
        own[:2] = of[0].sum(axis=2)
    return [own, *[x for c, t in enumerate(of) for x in layout.by_feature(c, t)]]


def _explained(
    rows: Rows, levels: list[Level], steps: np.ndarray, scale: float, kept: np.ndarray, kind: np.dtype
) -> Rows:
    """What is left of each row after a tree: ``scale * left - step`` of the leaf it falls in."""
    columns, left, _ = rows
    out, squares = np.empty_like(left), np.zeros(len(steps))
    for start in range(0, len(left), STEP):
        at = slice(start, min(start + STEP, len(left)))
        y = left[at]
        node = _walked(columns, at, np.zeros(at.stop - start, kind), levels).astype(np.intp)
        out[at] = scale * y - steps[node]
        squares += np.bincount(node, kept[at] * y * y, len(steps))
    return columns, out, squares


def _packed(layout: Layout):
    """Task function: the rows of a partition as one row of bytes."""
    schema = pa.schema([("columns", pa.list_(pa.binary())), ("label", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in layout.columns]
        labels: list[np.ndarray] = []
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            features = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            if not (np.isfinite(label).all() and np.isfinite(features).all()):
                raise ValueError("labels and features must be numbers, and finite")
            labels.append(label)
            for kept, new in zip(columns, layout.binned(features), strict=True):
                kept.append(new)
        if labels:
            data = [[np.concatenate(c).tobytes() for c in columns]], [np.concatenate(labels).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, schema.types, strict=True)], schema=schema)

    return run


# --- on the driver --------------------------------------------------------------------------


@dataclass
class Node:
    stats: np.ndarray
    depth: int
    gain: float = -1.0
    feature: int = -1
    left: np.ndarray | None = None  # which bins of the feature go left
    children: tuple[Node, Node] | None = None

    @property
    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0

    @property
    def impurity(self) -> float:
        n, total, squares = self.stats
        return float((squares - total * total / n) / n) if n else 0.0


def _best_splits(
    layout: Layout, nodes: list[Node], tables: list[np.ndarray], allowed: np.ndarray, least: int
) -> None:
    """Give each node its best split by variance, if one has a gain; the first one of equals.

    Categories are ordered by the mean of their rows, those without rows last.
    """
    sums = dict(zip([f for fs in layout.columns for f in fs], tables, strict=True))
    n, total, _ = np.array([x.stats for x in nodes]).T
    best = np.zeros(len(nodes))
    for f in sorted(sums):
        counts, added = sums[f]
        order = np.tile(np.arange(layout.bins[f]), (len(nodes), 1))
        if layout.cuts[f] is None:
            means = np.divide(added, counts, out=np.full_like(added, np.inf), where=counts > 0)
            order = np.argsort(means, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(counts, order, 1), axis=1)[:, :-1]
        part = np.cumsum(np.take_along_axis(added, order, 1), axis=1)[:, :-1]
        above, rest = n[:, None] - below, total[:, None] - part
        fits = (below >= least) & (above >= least) & (below > 0) & (above > 0) & allowed[:, f : f + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = part**2 / below + rest**2 / above - (total**2 / n)[:, None]
            gain = np.where(fits, gain / n[:, None], 0.0)
        at = gain.argmax(axis=1)
        most = np.take_along_axis(gain, at[:, None], 1)[:, 0]
        for i in np.flatnonzero(most > best):
            best[i] = most[i]
            left = np.zeros(layout.bins[f], bool)
            left[order[i, : at[i] + 1]] = True
            nodes[i].gain, nodes[i].feature, nodes[i].left = float(most[i]), f, left
            stats = np.array([below[i, at[i]], part[i, at[i]], 0.0]), np.array([above[i, at[i]], rest[i, at[i]], 0.0])
            nodes[i].children = tuple(Node(s, nodes[i].depth + 1) for s in stats)


def _level(layout: Layout, nodes: list[Node], kind: np.dtype) -> tuple[Level, list[Node]]:
    """The step from these nodes to the next ones: two for a split node, itself for another."""
    following: list[Node] = []
    tables: dict[int, np.ndarray] = {}
    # Rows that the tree does not look at stay behind the last node.
    same = np.zeros(len(nodes) + 1, kind)
    for i, node in enumerate(nodes):
        first = len(following)
        if node.children:
            c, own = layout.place(node.feature)
            table = tables.setdefault(c, np.zeros((len(nodes) + 1, layout.width(c)), kind))
            table[i] = np.where(node.left[own], first, first + 1)
            following += node.children
        else:
            same[i] = first
            following.append(node)
    same[-1] = len(following)
    next(iter(tables.values()))[:] += same[:, None]
    return sorted(tables.items()), following


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _total(parts: RDD | Here) -> list[np.ndarray]:
    """Arrays of all tasks added up, in the order of the tasks."""
    if parts.getNumPartitions() > MANY_TASKS:
        return parts.treeReduce(_added)
    first, *others = parts.collect()
    for other in others:
        first = _added(first, other)
    return first


def _told(leaves: list[Node], squares: np.ndarray) -> None:
    """Leaves learn their sum of squares after the tree is done."""
    for leaf, own in zip(leaves, squares, strict=True):
        leaf.stats[2] = own


def _only_checkpoint(rows: RDD | Here | None, old: str | None) -> str | None:
    """The checkpoint of these rows if they have one, after which the old one is not needed."""
    new = rows.getCheckpointFile() if rows is not None else None
    if old and (new or rows is None):
        sc = SparkContext.getOrCreate()
        path = sc._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return new or old


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    rate: float
    sampling: float
    features: int
    least: int
    every: int
    seed: int


class Here:
    """Parts of rows inside one task, with the calls that growing makes of an RDD."""

    def __init__(self, parts: list):
        self.parts = parts

    def mapPartitionsWithIndex(self, run, preservesPartitioning=False):
        return Here([x for i, part in enumerate(self.parts) for x in run(i, iter([part]))])

    def map(self, run):
        return Here([run(x) for x in self.parts])

    def collect(self) -> list:
        return self.parts

    def getNumPartitions(self) -> int:
        return 1

    def persist(self, level):
        return self

    def unpersist(self): ...

    def checkpoint(self): ...

    def getCheckpointFile(self): ...


def _allowed(how: Settings, nodes: list[Node], depth: int, n_features: int, seed: tuple[int, ...]) -> np.ndarray:
    """Which features may split which node: a share of them for a node of this depth with a variance."""
    draw = np.random.default_rng(seed)
    out = np.zeros((len(nodes), n_features), bool)
    for i, node in enumerate(nodes):
        if node.depth == depth < how.depth and node.impurity >= LEAST_IMPURITY:
            out[i, draw.permutation(n_features)[: how.features]] = True
    return out


def _boosted(rows: RDD | Here, layout: Layout, how: Settings) -> list[Node]:
    """The trees, one after the other. The rows of a tree are kept until those of the next one are."""
    share, seed, n_features, kind = how.sampling, how.seed, len(layout.bins), layout.place_kind(how.depth)
    trees: list[Node] = []
    leaves: list[Node] = []
    rows, before, written = rows.persist(StorageLevel.MEMORY_AND_DISK), None, None
    for m in range(how.trees):

        def kept(part, n, m=m):
            return _sampled(n, share, (seed, m, part)) if share < 1 else np.ones(n, bool)

        nodes: list[Node] = [Node(np.zeros(3), 0)]
        trees.append(nodes[0])
        levels: list[Level] = []
        for depth in range(max(1, how.depth)):

            def count(part, of_part, levels=levels, n=len(nodes), kept=kept):
                for r in of_part:
                    # The first level also brings the squares of the leaves of the tree before.
                    last = np.zeros(0) if levels or r[2] is None else r[2]
                    yield [last, *_figures(r, levels, n, layout, kept(part, len(r[1])), kind)]

            last, own, *tables = _total(rows.mapPartitionsWithIndex(count))
            for node, stats in zip(nodes, own.T, strict=True):
                node.stats = stats
            if not depth:
                _told(leaves, last)
                if before is not None:
                    before.unpersist()
                    written = _only_checkpoint(rows, written)
            _best_splits(layout, nodes, tables, _allowed(how, nodes, depth, n_features, (seed, m, depth)), how.least)
            if not any(x.children for x in nodes if x.depth == depth):
                break
            step, nodes = _level(layout, nodes, kind)
            levels = [*levels, step]
        # The first tree is fitted to the labels, those after it to twice the error.
        leaves, scale = nodes, 1.0 if m else 2.0
        steps = np.array([x.prediction for x in leaves]) * 2.0 * (how.rate if m else 1.0)

        def explain(part, of_part, levels=levels, steps=steps, scale=scale, kept=kept):
            for r in of_part:
                yield _explained(r, levels, steps, scale, kept(part, len(r[1])), kind)

        before, rows = rows, rows.mapPartitionsWithIndex(explain, True).persist(StorageLevel.MEMORY_AND_DISK)
        if how.every > 0 and (m + 1) % how.every == 0 and m + 1 < how.trees:
            rows.checkpoint()
    _told(leaves, _total(rows.map(lambda r: [r[2]]))[0])
    before.unpersist()
    rows.unpersist()
    _only_checkpoint(None, written)
    return trees


def _trees(rows: RDD, layout: Layout, how: Settings, n_rows: int) -> list[Node]:
    """Few rows are not worth a job for each level: one task takes their parts and grows all trees."""
    if n_rows > ONE_TASK_ROWS:
        return _boosted(rows, layout, how)
    [trees] = rows.coalesce(1).mapPartitions(lambda parts: [_boosted(Here(list(parts)), layout, how)]).collect()
    return trees


def _flat(layout: Layout, tree: Node) -> list[tuple]:
    """The nodes of a tree, each before those below it, as MLlib writes them."""
    out: list[tuple] = []

    def visit(node: Node) -> int:
        at = len(out)
        out.append(())
        below, split, gain = (-1, -1), (-1, [], -1), -1.0
        if node.children:
            below, gain = tuple(visit(x) for x in node.children), node.gain
            cuts = layout.cuts[node.feature]
            left = np.flatnonzero(node.left)
            if cuts is None:
                split = node.feature, [float(x) for x in left], layout.bins[node.feature]
            else:
                split = node.feature, [float(cuts[left[-1]])], -1
        stats = [float(x) for x in node.stats]
        out[at] = (at, node.prediction, node.impurity, stats, int(stats[0]), gain, *below, split)
        return at

    visit(tree)
    return out


class BinnedGBTRegressor(GBTRegressor):
    """MLlib's boosted trees for squared error, and its model, with another way to the trees.

    Rows are binned once and kept as a byte or so per feature, and numpy counts them. As in MLlib
    a tree takes one job for each of its levels over all rows, unless these are few; bins,
    splits, gains and steps are MLlib's. Rows and features of a tree are drawn by other random numbers.
    """

    def _fit_java(self, dataset: DataFrame):
        plain = self.getLossType() == "squared" and not any(
            self.isSet(p) for p in (self.weightCol, self.validationIndicatorCol, self.minInfoGain, self.minWeightFractionPerNode)
        )
        strategy = self.getFeatureSubsetStrategy()
        plain &= strategy in ALL_FEATURES or "." in strategy
        return self._grown(dataset) if plain else super()._fit_java(dataset)

    def _grown(self, dataset: DataFrame):
        spark = dataset.sparkSession
        use_checkpoints(spark)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("features"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
        )
        layout, n_rows = self._layout(dataset, rows)
        schema = "columns array<binary>, label binary"
        kinds = [np.min_scalar_type(layout.width(c) - 1) for c in range(len(layout.columns))]

        def unpacked(row) -> Rows:
            read = [np.frombuffer(x, kind) for x, kind in zip(row["columns"], kinds, strict=True)]
            return read, np.frombuffer(row["label"], np.float64), None

        packed = rows.mapInArrow(_packed(layout), schema).rdd.map(unpacked)
        return self._model(spark, layout, _trees(packed, layout, self._settings(len(layout.bins)), n_rows))

    def _layout(self, dataset: DataFrame, rows: DataFrame) -> tuple[Layout, int]:
        """Bins of the features, and the rows: values of a category, cuts of a number. As in MLlib these are found
        on a sample of at least 10,000 rows, or on all rows if there are fewer."""
        n = rows.count()
        if not n:
            raise ValueError("no rows to train on")
        attrs = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        values = {a["idx"]: 2 for a in attrs.get("binary", [])}
        values |= {a["idx"]: a.get("num_vals") or len(a["vals"]) for a in attrs.get("nominal", []) if a.keys() & {"vals", "num_vals"}}
        needed = max(self.getMaxBins() ** 2, 10_000)
        some = rows if n <= needed else rows.sample(False, needed / n, self.getSeed())
        sample = np.array([r[0] for r in some.select("features").collect()])
        most = min(self.getMaxBins(), n) - 1
        cuts = [None if f in values else thresholds(sample[:, f], most) for f in range(sample.shape[1])]
        return Layout(cuts, [values[f] if c is None else len(c) + 1 for f, c in enumerate(cuts)]), n

    def _settings(self, n_features: int) -> Settings:
        strategy = self.getFeatureSubsetStrategy()
        return Settings(
            trees=self.getMaxIter(), depth=self.getMaxDepth(), rate=self.getStepSize(), sampling=self.getSubsamplingRate(),
            features=n_features if strategy in ALL_FEATURES else int(np.ceil(float(strategy) * n_features)),
            least=self.getMinInstancesPerNode(), every=self.getCheckpointInterval(), seed=abs(self.getSeed()),
        )

    def _model(self, spark: SparkSession, layout: Layout, trees: list[Node]):
        """The trees as MLlib reads a saved model, read back."""
        path = fresh_path(spark, "trees")
        set_, default = ({p.name: v for p, v in m.items()} for m in (self._paramMap, self._defaultParamMap))

        def about(kind: str, uid: str, keep, **more) -> str:
            params = [{k: v for k, v in m.items() if keep(k)} for m in (set_, default)]
            return json.dumps(
                {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
                | dict(zip(("paramMap", "defaultParamMap"), params, strict=True)) | more
            )

        def write(rows: list, schema: str):
            return spark.createDataFrame(rows, schema, verifySchema=False).coalesce(1).write

        n = len(layout.bins)
        head = about("GBTRegressionModel", self.uid, lambda k: True, numFeatures=n, numTrees=len(trees))
        write([(head,)], "value string").text(f"{path}/metadata")
        each = [
            (i, about("DecisionTreeRegressionModel", f"dtr_{self.uid}_{i}", TREE_PARAMS.__contains__, numFeatures=n),
             self.getStepSize() if i else 1.0)
            for i in range(len(trees))
        ]
        write(each, "_1 int, _2 string, _3 double").parquet(f"{path}/treesMetadata")
        nodes = [(i, node) for i, tree in enumerate(trees) for node in _flat(layout, tree)]
        write(nodes, f"treeID int, nodeData struct<{NODE}>").parquet(f"{path}/data")
        return spark._jvm.org.apache.spark.ml.regression.GBTRegressionModel.load(path)
