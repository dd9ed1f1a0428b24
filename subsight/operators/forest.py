"""Random forests whose nodes stay on the executors, for two classes.

Rows are binned and written as blocks. The top of each tree is grown level by level:
tasks count their blocks, Spark adds the counts per tree, and the driver learns one
split a node. A node with few enough rows is a cell: its rows are gathered from the
blocks and one task grows it to the end, many cells side by side. So a task holds a
bounded number of rows, and the driver the tops only, about two nodes a cell.

Draws are hashes of the row, the tree and the node, so a forest is the same in every run,
and one of less depth or fewer trees is the beginning of a larger one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.functions.sizes import small_side
from subsight.sources.tables import materialize

#: A node whose drawn rows weigh at most so much is grown to the end in one task.
CELL_ROWS = 1 << 15
#: A cell that more rows to score come to is copied to several tasks, one for so many.
PART_ROWS = 1 << 18
#: Values of a feature that splits tell apart.
MAX_BINS = 32
#: Bytes of counts a task holds before it passes them on.
COUNT_BYTES = 1 << 26
#: Splits that gain no more than rounding are none.
MIN_GAIN = 1e-12
LEAF, OPEN = -1, -2
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_NODE = [("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("n0", "<i8"), ("n1", "<i8"), ("level", "u1"), ("gain", "<f8")]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 hash."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the bootstrap of a tree draws each row: a Poisson number of mean 1."""
    salt = _mixed(np.array([seed * 1_000_003 + tree], dtype=np.int64).astype(np.uint64))
    uniform = (_mixed(keys ^ salt) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.uint8)


def _looked_at(seed: int, tree: int, cell: int, level: int, nodes: int, width: int, m: int) -> np.ndarray:
    """``m`` features for each node of a level, drawn without replacement; all in order if that is all."""
    if m == width:
        return np.tile(np.arange(width), (nodes, 1))
    order = np.random.default_rng([seed & 0xFFFFFFFF, tree, cell + 1, level]).random((nodes, width))
    return np.argsort(order, axis=1)[:, :m]


def _impurity(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    n = np.maximum(a + b, 1)
    p, q = a / n, b / n
    if kind == "gini":
        return 1 - p * p - q * q
    return -(p * np.log2(np.where(p > 0, p, 1)) + q * np.log2(np.where(q > 0, q, 1)))


def best_splits(keys: np.ndarray, c0: np.ndarray, c1: np.ndarray, nodes: int, m: int, kind: str) -> tuple:
    """``(gain, slot of the feature, bin, left counts of both classes)`` of the best split of each node.

    ``keys`` are ``(node * m + slot) * MAX_BINS + bin``, rising, each with its counts; rows
    up to the bin go left. Of equal splits the first one counts. No split has gain 0.
    """
    gains, at = np.zeros(nodes), np.zeros(nodes, dtype=np.intp)
    l0, l1 = np.cumsum(c0), np.cumsum(c1)
    if len(keys):
        group = keys // MAX_BINS
        ends = np.append(np.flatnonzero(np.diff(group)), len(keys) - 1)
        run = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
        t0, t1 = l0[ends], l1[ends]
        b0, b1 = np.append(0, t0[:-1])[run], np.append(0, t1[:-1])[run]
        l0, l1, t0, t1 = l0 - b0, l1 - b1, t0[run] - b0, t1[run] - b1
        r0, r1, n = t0 - l0, t1 - l1, t0 + t1
        spread = (l0 + l1) * _impurity(l0, l1, kind) + (r0 + r1) * _impurity(r0, r1, kind)
        gain = np.where(r0 + r1 > 0, _impurity(t0, t1, kind) - spread / n, 0.0)
        node = group // m
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        most = np.maximum.reduceat(gain, begins)
        hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(begins, len(node)))))
        own, first = np.unique(node[hit], return_index=True)
        gains[own], at[own] = gain[hit[first]], hit[first]
    if not len(keys):
        return gains, at, at, at, at
    return gains, keys[at] // MAX_BINS % m, keys[at] % MAX_BINS, l0[at], l1[at]


class Nodes:
    """The nodes of a tree or of a cell, each level after the one above."""

    def __init__(self, n0: int, n1: int, level: int = 0):
        self.rows = np.array([(OPEN, 0, 0, n0, n1, level, 0)], dtype=_NODE)

    def close(self, at: np.ndarray) -> None:
        self.rows["feature"][at] = LEAF

    def split(self, at, feature, cut, l0, l1, gain) -> np.ndarray:
        """Split nodes; the children, open, by pairs at the end. Returns the number of the first child of each."""
        first = len(self.rows) + 2 * np.arange(len(at))
        n0, n1, level = (self.rows[k][at] for k in ("n0", "n1", "level"))
        for name, values in (("feature", feature), ("cut", cut), ("left", first), ("gain", gain)):
            self.rows[name][at] = values
        new = np.zeros(2 * len(at), dtype=_NODE)
        new["feature"], new["level"] = OPEN, np.repeat(level + 1, 2)
        new["n0"], new["n1"] = np.stack([l0, n0 - l0], 1).ravel(), np.stack([l1, n1 - l1], 1).ravel()
        self.rows = np.concatenate((self.rows, new))
        return first

    def prune(self) -> None:
        """Two leaves of the same prediction become one, from the deepest level up."""
        rows = self.rows
        for level in range(int(rows["level"].max()), -1, -1):
            at = np.flatnonzero((rows["level"] == level) & (rows["feature"] >= 0))
            left, votes = rows["left"][at], rows["n1"] > rows["n0"]
            both = (rows["feature"][left] == LEAF) & (rows["feature"][left + 1] == LEAF) & (votes[left] == votes[left + 1])
            self.close(at[both])

    def up_to(self, depth: int) -> Nodes:
        """The same nodes, grown to a smaller depth; what lies below is no longer come to."""
        found = Nodes.__new__(Nodes)
        found.rows = self.rows.copy()
        found.rows["feature"][found.rows["level"] >= depth] = LEAF
        return found

    def importances(self, width: int) -> np.ndarray:
        inner = self.rows[self.rows["feature"] >= 0]
        return np.bincount(inner["feature"], inner["gain"] * (inner["n0"] + inner["n1"]), width)

    def depth(self) -> int:
        inner = self.rows["level"][self.rows["feature"] >= 0]
        return int(inner.max()) + 1 if len(inner) else int(self.rows["level"][0])

    def probabilities(self) -> np.ndarray:
        return self.rows["n1"] / np.maximum(self.rows["n0"] + self.rows["n1"], 1)


def walk(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node without children that each row comes to."""
    at = np.zeros(len(bins), dtype=np.int64)
    live = np.arange(len(bins)) if nodes["feature"][0] >= 0 else np.arange(0)
    while len(live):
        here = at[live]
        down = nodes["left"][here] + (bins[live, nodes["feature"][here]] > nodes["cut"][here])
        at[live] = down
        live = live[nodes["feature"][down] >= 0]
    return at


def grow_cell(bins, label, weight, level: int, draw: tuple[int, int, int], depth: int, m: int, kind: str) -> Nodes:
    """The pruned nodes of a cell."""
    nodes = grow_whole(bins, label, weight, level, draw, depth, m, kind)
    nodes.prune()
    return nodes


def grow_whole(bins, label, weight, level: int, draw: tuple[int, int, int], depth: int, m: int, kind: str) -> Nodes:
    """Grow the rows of a cell until leaves are pure, cannot be split, or are deep enough."""
    n1 = int(weight[label == 1].sum(dtype=np.int64))
    nodes = Nodes(int(weight.sum(dtype=np.int64)) - n1, n1, level)
    at, place = np.array([0]), np.zeros(len(bins), dtype=np.int64)  # open nodes, and each row's among them
    while True:
        done = (nodes.rows["n0"][at] == 0) | (nodes.rows["n1"][at] == 0) | (level >= depth)
        nodes.close(at[done])
        kept = ~done[place]
        place, bins, label, weight = (np.cumsum(~done) - 1)[place[kept]], bins[kept], label[kept], weight[kept]
        at = at[~done]
        if not len(at):
            break
        looked = _looked_at(*draw, level, len(at), bins.shape[1], m)
        cells = (place[:, None] * m + np.arange(m)) * MAX_BINS + np.take_along_axis(bins, looked[place], axis=1)
        packed = (cells << 9 | (label.astype(np.int64) << 8 | weight)[:, None]).ravel()
        packed.sort()
        begins = np.flatnonzero(np.diff(packed >> 9, prepend=-1))
        some, one = packed & 255, packed >> 8 & 1
        c1, both = np.add.reduceat(some * one, begins), np.add.reduceat(some, begins)
        gain, slot, cut, l0, l1 = best_splits(packed[begins] >> 9, both - c1, c1, len(at), m, kind)
        good = gain > MIN_GAIN
        nodes.close(at[~good])
        feature = looked[np.arange(len(at)), slot]
        first = nodes.split(at[good], feature[good], cut[good], l0[good], l1[good], gain[good])
        kept = good[place]
        old, bins, label, weight = place[kept], bins[kept], label[kept], weight[kept]
        right = np.take_along_axis(bins, feature[old][:, None], axis=1)[:, 0] > cut[old]
        place = 2 * (np.cumsum(good) - 1)[old] + right
        at = np.stack([first, first + 1], 1).ravel()
        level += 1
    return nodes


def feature_cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Where each feature of ``x`` is cut: between all its values if they are few, else at quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.array([])] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            # One more value than there are bins tells that they are many.
            seen = [np.unique(np.append(s, x[:, f]))[: MAX_BINS + 1] for f, s in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(range(width), pa.int32()), "vals": pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))})

    found = rows.select("x").mapInArrow(few, "feature int, vals array<double>")
    merged = found.groupBy("feature").agg(F.array_distinct(F.flatten(F.collect_list("vals"))).alias("vals"))
    values = {r["feature"]: np.unique(r["vals"]) for r in merged.collect()}  # MAX_BINS + 1 a feature and task
    many = [f for f in range(width) if len(values[f]) > MAX_BINS]
    cuts = {f: (v[:-1] + v[1:]) / 2 for f, v in values.items()}
    if many:
        grid = [i / MAX_BINS for i in range(1, MAX_BINS)]
        x = F.col("x")
        got = rows.agg(*[F.percentile_approx(x[f], grid, 10_000).alias(f"q{f}") for f in many], *[F.max(x[f]).alias(f"m{f}") for f in many]).first()
        for f in many:
            q = np.unique([float(values[f][0]), *got[f"q{f}"]])
            cuts[f] = q[q < got[f"m{f}"]][-(MAX_BINS - 1) :]
    return [cuts[f] for f in range(width)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], others: list[str]) -> DataFrame:
    """``(block, n, bins, rest)``: binned rows by the batch, other columns as they come; written."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            bins = _bins(_matrix(batch.column("x"), len(cuts)), cuts)
            rest = batch.select(others)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([base + i], pa.int64()),
                    "n": pa.array([len(batch)], pa.int64()),
                    "bins": pa.array([bins.tobytes()], pa.binary()),
                    "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                }
            )

    return materialize(rows.select("x", *others).mapInArrow(packed, "block long, n long, bins binary, rest binary"))


def _unpacked(rest: bytes) -> pa.Table:
    return pa.ipc.open_stream(rest).read_all()


def _binned(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint8).reshape(-1, width)


def _grouped(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that hold it."""
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    for places in np.split(order, begins[1:]) if len(at) else ():
        yield int(at[places[0]]), places


class CellForest(Estimator, HasFeaturesCol, HasLabelCol):
    """A forest of trees on bootstrapped rows, each node splitting by the best of some random features."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", TypeConverters.toString)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "sqrt, all or a number", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numTrees=100, maxDepth=5, impurity="gini", featureSubsetStrategy="sqrt", seed=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", numTrees=100, maxDepth=5, impurity="gini", featureSubsetStrategy="sqrt", seed=0)
        self._set(**self._input_kwargs)

    def looked_at(self, width: int) -> int:
        """Features looked at in a node."""
        text = self.getOrDefault(self.featureSubsetStrategy)
        if text in ("sqrt", "all"):
            return width if text == "all" else math.ceil(math.sqrt(width))
        return max(1, min(width, int(text)))

    def _fit(self, dataset: DataFrame) -> CellForestModel:
        depth = self.getOrDefault(self.maxDepth)
        return self.fit_depths(dataset, [depth])[depth]

    def fit_depths(self, dataset: DataFrame, depths: list[int]) -> dict[int, CellForestModel]:
        """The forest of each depth, in the place of ``maxDepth``. All are cut from one that is grown to the largest."""
        depths = sorted(set(depths))
        trees, kind, seed = (self.getOrDefault(p) for p in (self.numTrees, self.impurity, self.seed))
        features = F.col(self.getFeaturesCol())
        x = vector_to_array(features) if isinstance(dataset.schema[self.getFeaturesCol()].dataType, VectorUDT) else features
        others = [F.col(c) for c in dataset.columns if c not in (self.getFeaturesCol(), self.getLabelCol())]
        label = F.col(self.getLabelCol()).cast("int").alias("y")
        # Rows are told by all they hold, so the draw depends on no order; rows that repeat draw alike.
        rows = dataset.select(x.alias("x"), label, F.xxhash64(*others, "y", "x").alias("k") if others else F.xxhash64("y", "x").alias("k"))
        some = rows.first()
        if some is None:
            raise ValueError("no rows to fit")
        width = len(some["x"])
        m = self.looked_at(width)
        cuts = feature_cuts(rows, width)
        blocks = _blocks(rows, cuts, ["y", "k"])
        tops = _grown_tops(blocks, width, trees, depths[-1], m, kind, seed)
        cells = _grown_cells(blocks, tops, width, depths, m, kind, seed)
        return {
            d: CellForestModel(self.getFeaturesCol(), cuts, [t.up_to(d) for t in tops], cells.where(F.col("grown_to") == d).drop("grown_to"))
            for d in depths
        }


def _train_block(bins: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = _unpacked(rest)
    return _binned(bins, width), own["y"].to_numpy(), own["k"].to_numpy().view(np.uint64)


def _grown_tops(blocks: DataFrame, width: int, trees: int, depth: int, m: int, kind: str, seed: int) -> list[Nodes]:
    """The top of each tree; nodes still open are cells."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 2), dtype=np.int64)
        for batch in batches:
            for bins, rest in zip(batch.column("bins").to_pylist(), batch.column("rest").to_pylist()):
                _, y, k = _train_block(bins, rest, width)
                for tree in range(trees):
                    total[tree] += np.bincount(y, drawn(k, seed, tree), 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["tree", "n0", "n1"])

    summed = blocks.select("bins", "rest").mapInArrow(classes, "tree int, n0 long, n1 long").groupBy("tree").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    tops = [Nodes(r["n0"], r["n1"]) for r in sorted(summed.collect())]
    level = 0
    while True:
        wide: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # tree: nodes to split now, features they look at
        for tree, top in enumerate(tops):
            own = top.rows
            at = np.flatnonzero((own["feature"] == OPEN) & (own["level"] == level))
            done = (own["n0"][at] == 0) | (own["n1"][at] == 0) | (level >= depth)
            top.close(at[done])
            at = at[~done]
            at = at[own["n0"][at] + own["n1"][at] > CELL_ROWS]
            if len(at):
                wide[tree] = at, _looked_at(seed, tree, -1, level, len(at), width, m)
        if not wide:
            return tops
        nodes = {tree: tops[tree].rows for tree in wide}

        def counted(batches: Iterator[pa.RecordBatch], wide=wide, nodes=nodes) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict(
                    {"tree": pa.array(list(held), pa.int32()), "part": pa.array([h.tobytes() for h in held.values()], pa.binary())}
                )

            for batch in batches:
                for bins, rest in zip(batch.column("bins").to_pylist(), batch.column("rest").to_pylist()):
                    x, y, k = _train_block(bins, rest, width)
                    for tree, (at, looked) in wide.items():
                        w = drawn(k, seed, tree)
                        place = np.full(len(nodes[tree]), -1)
                        place[at] = np.arange(len(at))
                        own = place[walk(nodes[tree], x)]
                        rows = np.flatnonzero((w > 0) & (own >= 0))
                        own = own[rows]
                        cells = (own[:, None] * m + np.arange(m)) * MAX_BINS + np.take_along_axis(x[rows], looked[own], axis=1)
                        counts = np.bincount((cells * 2 + y[rows][:, None]).ravel(), np.repeat(w[rows], m), len(at) * m * MAX_BINS * 2).astype(np.int64)
                        held[tree] = held[tree] + counts if tree in held else counts
                        if sum(h.nbytes for h in held.values()) > COUNT_BYTES:
                            yield out()
                            held.clear()
            if held:
                yield out()

        def decided(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            at, looked = wide[int(key[0])]  # noqa: B023
            total = np.frombuffer(parts["part"].iloc[0], dtype=np.int64).copy()
            for part in parts["part"].iloc[1:]:
                total += np.frombuffer(part, dtype=np.int64)
            c0, c1 = total.reshape(-1, 2).T
            keys = np.flatnonzero(c0 + c1)
            gain, slot, cut, l0, l1 = best_splits(keys, c0[keys], c1[keys], len(at), m, kind)
            feature = looked[np.arange(len(at)), slot]
            return pd.DataFrame({"tree": int(key[0]), "node": at, "feature": feature, "cut": cut, "l0": l0, "l1": l1, "gain": gain})

        parts = blocks.select("bins", "rest").mapInArrow(counted, "tree int, part binary")
        found = parts.groupBy("tree").applyInPandas(decided, "tree int, node int, feature int, cut int, l0 long, l1 long, gain double")
        chosen: dict[int, list] = {}
        for r in sorted(found.collect()):  # the wide nodes of a level
            chosen.setdefault(r["tree"], []).append(tuple(r)[1:])
        for tree, rows in chosen.items():
            at, feature, cut, l0, l1, gain = map(np.array, zip(*rows))
            good = gain > MIN_GAIN
            tops[tree].close(at[~good])
            tops[tree].split(at[good], feature[good], cut[good], l0[good], l1[good], gain[good])
        level += 1


def _grown_cells(blocks: DataFrame, tops: list[Nodes], width: int, depths: list[int], m: int, kind: str, seed: int) -> DataFrame:
    """``(grown_to, tree, cell, nodes, depth, importances)`` of each cell and depth; written.

    A cell has the number of its node. It is grown once, to the largest depth, and cut to the others that reach it.
    """
    nodes = [top.rows for top in tops]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, rest in zip(batch.column("bins").to_pylist(), batch.column("rest").to_pylist()):
                x, y, k = _train_block(bins, rest, width)
                whole = np.column_stack([x, y.astype(np.uint8), np.zeros(len(x), dtype=np.uint8)])
                for tree, own in enumerate(nodes):
                    whole[:, -1] = drawn(k, seed, tree)
                    kept = whole[whole[:, -1] > 0]
                    out = [(c, kept[rows].tobytes()) for c, rows in _grouped(walk(own, kept)) if own["feature"][c] == OPEN]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree] * len(out), pa.int32()), pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                            names=["tree", "cell", "rows"],
                        )

    def grown(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        tree, cell = int(key[0]), int(key[1])
        rows = np.frombuffer(b"".join(sorted(parts["rows"])), dtype=np.uint8).reshape(-1, width + 2)
        level = int(nodes[tree]["level"][cell])
        whole = grow_whole(rows[:, :width], rows[:, width], rows[:, width + 1], level, (seed, tree, cell), depths[-1], m, kind)
        out = []
        for depth in depths:
            if level >= depth:
                continue
            found = whole.up_to(depth)
            found.prune()
            slim = np.rec.fromarrays([found.rows[c] for c in ("feature", "cut", "left")] + [found.probabilities()], dtype=_SCORED)
            is_leaf = bool(found.rows[0]["feature"] == LEAF)
            out.append((depth, tree, cell, slim.tobytes(), is_leaf, found.depth(), found.importances(width)))
        return pd.DataFrame(out, columns=["grown_to", "tree", "cell", "nodes", "is_leaf", "depth", "importances"])

    parts = blocks.select("bins", "rest").mapInArrow(sent, "tree int, cell int, rows binary")
    return materialize(
        parts.groupBy("tree", "cell").applyInPandas(
            grown, "grown_to int, tree int, cell int, nodes binary, is_leaf boolean, depth int, importances array<double>"
        )
    )


_SCORED = [("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("p", "<f8")]


class CellForestModel(Model):
    """A grown forest: tops on the driver, cells in a written table."""

    def __init__(self, features: str, cuts: list[np.ndarray], tops: list[Nodes], cells: DataFrame):
        super().__init__()
        self.features, self.cuts, self.tops, self.cells = features, cuts, tops, cells
        width = len(cuts)

        def of_tree(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            kept = own.sort_values("cell")
            leaves = kept["cell"][kept["is_leaf"]].tolist()
            return pd.DataFrame({"tree": [key[0]], "depth": [kept["depth"].max()], "leaves": [leaves], "importances": [np.sum(np.stack(kept["importances"]), axis=0)]})

        summed = cells.drop("nodes").groupBy("tree").applyInPandas(of_tree, "tree int, depth int, leaves array<int>, importances array<double>")
        below = {r["tree"]: r for r in summed.collect()}  # a row a tree
        for t, r in below.items():
            tops[t].close(np.array(r["leaves"], dtype=np.intp))
            # A top that is pruned leaves cells behind that no row comes to.
            tops[t].prune()
        self.depths = [max(top.depth(), below[t]["depth"] if t in below else 0) for t, top in enumerate(tops)]
        total = np.zeros(width)
        for t, top in enumerate(tops):
            own = top.importances(width) + (np.array(below[t]["importances"]) if t in below else 0)
            total += own / own.sum() if own.sum() > 0 else 0
        self.featureImportances: DenseVector = Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``probability`` of both classes, the mean over the trees, and ``prediction``; written.

        Rows go tree by tree to the cell they fall into, and the answers come back to their block.
        """
        width, cuts, tops = len(self.cuts), self.cuts, self.tops
        nodes, known = [t.rows for t in tops], [t.probabilities() for t in tops]
        others = [c for c in dataset.columns if c != self.features]
        vector = isinstance(dataset.schema[self.features].dataType, VectorUDT)
        x = vector_to_array(self.features) if vector else F.col(self.features)
        rows = dataset.select(x.alias("x"), F.struct(x.alias("x"), *others).alias("rest"))
        kind = _nullable(rows.schema["rest"].dataType)
        rows = rows.withColumn("rest", F.col("rest").cast(kind))
        blocks = _blocks(rows, cuts, ["rest"])
        total = blocks.agg(F.sum("n")).first()[0] or 0

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch.column("block").to_pylist(), batch.column("bins").to_pylist()):
                    bins = _binned(blob, width)
                    sums = np.zeros(len(bins))
                    for tree, own in enumerate(nodes):
                        out = []
                        for cell, at in _grouped(walk(own, bins)):
                            if own["feature"][cell] == OPEN:
                                out.append((block, tree, cell, at.astype("<i4").tobytes(), bins[at].tobytes()))
                            else:
                                sums[at] += known[tree][cell]
                        if out:
                            yield _sent_batch(out)
                    # What the tops know already goes back as if from a cell of its own in each block.
                    yield _sent_batch([(block, -1, -1, sums.tobytes(), b"")])

        def scored(key: tuple, rows: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(cell):
                return pd.DataFrame({"block": [], "rows": [], "p": [], "tree": [], "cell": []})
            own = np.frombuffer(cell["nodes"].iloc[0], dtype=_SCORED)
            p = [own["p"][walk(own, _binned(b, width))].tobytes() for b in rows["bins"]]
            return pd.DataFrame({"block": rows["block"], "rows": rows["rows"], "p": p, "tree": int(key[0]), "cell": int(key[1])})

        def told(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
            sums = np.zeros(block["n"][0].as_py())
            order = np.lexsort([found["cell"].to_numpy(), found["tree"].to_numpy()])
            at, p = found["rows"].to_pylist(), found["p"].to_pylist()
            for i in order.tolist():
                if p[i] is None:
                    sums += np.frombuffer(at[i])
                else:
                    sums[np.frombuffer(at[i], dtype="<i4")] += np.frombuffer(p[i])
            rest = _unpacked(block["rest"][0].as_py())
            return pa.table({"rest": rest["rest"], "p": pa.array(np.clip(sums / len(nodes), 0, 1))})

        routed = materialize(blocks.select("block", "bins").mapInArrow(sent, "block long, tree int, cell int, rows binary, bins binary"))
        keyed, cells = _dealt(routed.where("tree >= 0"), self.cells.select("tree", "cell", "nodes"), total)
        by = ["tree", "cell", "part"]

        answers = keyed.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(scored, "block long, rows binary, p binary, tree int, cell int")
        first = routed.where("tree < 0").select("block", "rows", F.lit(None).cast("binary").alias("p"), "tree", "cell")
        everything = answers.unionByName(first)
        schema = T.StructType([T.StructField("rest", kind), T.StructField("p", T.DoubleType())])
        told_rows = blocks.groupBy("block").cogroup(everything.groupBy("block")).applyInArrow(told, schema)
        kept = materialize(told_rows)
        own = array_to_vector("rest.x") if vector else F.col("rest.x")
        return kept.select(
            *[own.alias(c) if c == self.features else F.col("rest")[c].alias(c) for c in dataset.columns],
            array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("probability"),
            (F.col("p") > 0.5).cast("double").alias("prediction"),
        )


def _dealt(routed: DataFrame, cells: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both with a ``part``: a cell is copied for each ``PART_ROWS`` of its own rows, so copies do not grow with cells times rows."""
    if total <= PART_ROWS:  # no cell has more
        return routed.withColumn("part", F.lit(0)), cells.withColumn("part", F.lit(0))
    count = F.ceil(F.sum(F.octet_length("rows") / 4) / PART_ROWS).cast("int")
    crowded = small_side(routed.groupBy("tree", "cell").agg(count.alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = routed.join(crowded, ["tree", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("block"), parts).cast("int"))
    copied = cells.join(crowded, ["tree", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("parts"), copied.drop("parts")


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed throughout, as Arrow hands it back."""
    text = kind.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true')
    return type(kind).fromJson(json.loads(text.replace('"valueContainsNull":false', '"valueContainsNull":true')))


def _sent_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "tree", "cell", "rows", "bins"])
