"""Tree ensembles as flat arrays: read and write the text format, score in Arrow batches, all rounds of an ensemble in one pass.

An expression of nested conditions outgrows generated code at some dozens of trees; here a model is
a few arrays that go to the executors once, and one routine walks all trees of a batch's rows level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the text format: bits of a node's decision type, and how a missing value is told (bits 2 and 3).
CATEGORICAL, MISSING_LEFT = 1, 2
MISSING_NEVER, MISSING_ZERO, MISSING_NAN = 0, 1, 2
#: Fixed value: what is no larger than this is zero.
TINY = 1e-35


@dataclass
class Forest:
    """All nodes of all trees. A child of 0 or more is a node, one below is the leaf `~child`; `roots` are such, too."""

    names: list[str]
    sigmoid: float = 1.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kind: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of a categorical node: where its words of 32 levels begin and end in `words`.
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.roots)

    def prefix(self, trees: int) -> Forest:
        """The first trees only; their nodes stay where they are."""
        return Forest(**{**self.__dict__, "roots": self.roots[:trees]})

    def _left(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        kind, unknown = self.kind[node], np.isnan(x)
        how = kind >> 2 & 3
        value = np.where(unknown & (how != MISSING_NAN), 0.0, x)
        missing = np.where(how == MISSING_ZERO, np.abs(value) <= TINY, (how == MISSING_NAN) & unknown)
        out = np.where(missing, (kind & MISSING_LEFT) > 0, value <= self.threshold[node])
        listed = np.flatnonzero(kind & CATEGORICAL)
        if len(listed):
            at, level = node[listed], np.trunc(np.where(unknown[listed], -1.0, x[listed]))
            level = np.where((level >= 0) & (level < 2.0**31), level, -1.0).astype(np.int64)
            word = self.first[at] + (level >> 5)
            inside = (level >= 0) & (word < self.last[at])
            out[listed] = inside & (self.words[np.where(inside, word, 0)] >> (level & 31) & 1 == 1)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: the value of the leaf that each row reaches. x: rows x names, NaN where unknown."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while len(open_ := np.flatnonzero(at.ravel() >= 0)):
            node = at.ravel()[open_]
            go = self._left(node, x[open_ // len(self), self.feature[node]])
            at.ravel()[open_] = np.where(go, self.left[node], self.right[node])
        return self.leaf[~at]

    def probability(self, x: np.ndarray, rows: int = 2000) -> np.ndarray:
        parts = [self.leaves(x[i : i + rows]).sum(axis=1) for i in range(0, len(x), rows)]
        return 1 / (1 + np.exp(-self.sigmoid * np.concatenate(parts or [np.zeros(0)])))


def parse_text_model(text: str) -> Forest:
    """A text model: key=value lines, a block per tree. Trees of one leaf, category bitsets and all ways of missing are known."""
    head, *blocks = text.split("\nTree=")
    pairs = lambda lines: dict(line.split("=", 1) for line in lines.splitlines() if "=" in line)
    keys = pairs(head)
    objective = keys.get("objective", "").split()
    slope = next((float(x.split(":")[1]) for x in objective if x.startswith("sigmoid:")), 1.0)
    out: dict[str, list] = {n: [] for n in ("roots", "feature", "threshold", "kind", "left", "right", "leaf", "first", "last", "words")}
    for block in blocks:
        v = pairs(block.split("\nend of trees")[0])
        ints = lambda k: [int(x) for x in v.get(k, "").split()]  # noqa: B023, E731
        floats = lambda k: [float(x) for x in v.get(k, "").split()]  # noqa: B023, E731
        node, leaf, word = len(out["feature"]), len(out["leaf"]), len(out["words"])
        child = lambda c: c + node if c >= 0 else ~(~c + leaf)  # noqa: B023, E731
        feature, kind, threshold, edge = ints("split_feature"), ints("decision_type"), floats("threshold"), ints("cat_boundaries")
        out["roots"].append(node if feature else ~leaf)
        out["feature"] += feature
        out["kind"] += kind or [0] * len(feature)
        out["threshold"] += threshold
        out["left"] += map(child, ints("left_child"))
        out["right"] += map(child, ints("right_child"))
        out["leaf"] += floats("leaf_value")
        out["words"] += ints("cat_threshold")
        for k, t in zip(kind or [0] * len(feature), threshold, strict=True):
            a, b = (edge[int(t)], edge[int(t) + 1]) if k & CATEGORICAL else (0, 0)
            out["first"].append(word + a)
            out["last"].append(word + b)
    real = ("threshold", "leaf")
    return Forest(keys["feature_names"].split(), slope, **{k: np.array(x, float if k in real else np.int64) for k, x in out.items()})


def text_model(forest: Forest) -> str:
    """The model as text, which parse_text_model reads back to the same scores."""
    blocks = []
    for n, root in enumerate(forest.roots):
        nodes, leaves, queue = [], [], [int(root)]
        for c in queue:  # breadth first: a tree's nodes and leaves, numbered as met
            (nodes if c >= 0 else leaves).append(c)
            queue += [int(forest.left[c]), int(forest.right[c])] if c >= 0 else []
        number = {c: i for i, c in enumerate(nodes)} | {c: ~i for i, c in enumerate(leaves)}
        edges, words, thresholds = [0], [], []
        for c in nodes:
            thresholds.append(repr(float(forest.threshold[c])))
            if forest.kind[c] & CATEGORICAL:
                thresholds[-1] = str(len(edges) - 1)
                words += [int(w) for w in forest.words[forest.first[c] : forest.last[c]]]
                edges.append(len(words))
        rows = {"num_leaves": [len(leaves)], "num_cat": [len(edges) - 1], "split_feature": [int(forest.feature[c]) for c in nodes], "threshold": thresholds, "decision_type": [int(forest.kind[c]) for c in nodes]}
        rows |= {"left_child": [number[int(forest.left[c])] for c in nodes], "right_child": [number[int(forest.right[c])] for c in nodes], "leaf_value": [repr(float(forest.leaf[~c])) for c in leaves]}
        rows |= {"cat_boundaries": edges, "cat_threshold": words} if words else {}
        blocks.append(f"Tree={n}\n" + "".join(f"{k}={' '.join(map(str, x))}\n" for k, x in rows.items()) + "\n")
    head = {"version": "v4", "num_class": "1", "num_tree_per_iteration": "1", "label_index": "0", "max_feature_idx": str(len(forest.names) - 1), "objective": f"binary sigmoid:{forest.sigmoid:g}", "feature_names": " ".join(forest.names)}
    return "tree\n" + "".join(f"{k}={v}\n" for k, v in head.items()) + "\n" + "\n".join(blocks) + "\nend of trees\n"


def forest_of(model, names: list[str], unknown: float = -1.0) -> Forest:
    """Spark's boosted trees as a forest, whose margin counts twice. An unknown input goes where `unknown` goes, which stood for it in training."""
    out: dict[str, list] = {n: [] for n in ("roots", "feature", "threshold", "kind", "left", "right", "leaf")}

    def add(node, weight: float) -> int:
        if node.subtreeDepth() == 0:
            out["leaf"].append(weight * node.prediction())
            return ~(len(out["leaf"]) - 1)
        at = len(out["feature"])
        out["feature"].append(node.split().featureIndex())
        out["threshold"].append(node.split().threshold())
        out["kind"].append(MISSING_NAN << 2 | (MISSING_LEFT if unknown <= out["threshold"][at] else 0))
        out["left"].append(0)
        out["right"].append(0)
        out["left"][at], out["right"][at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        out["roots"].append(add(tree._java_obj.rootNode(), weight))
    arrays = {k: np.array(x, float if k in ("threshold", "leaf") else np.int64) for k, x in out.items()}
    none = np.zeros(len(out["feature"]), np.int64)
    return Forest(list(names), 2.0, **arrays, first=none, last=none.copy())


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def inputs_of(forest: Forest, column_of=F.col) -> Column:
    """The model's inputs as one array, in its order."""
    return F.array(*[column_of(n).cast("double") for n in forest.names])


def probability(forest: Forest, column_of=F.col) -> Column:
    """The probability of a row whose columns have the model's names; null and NaN are unknown."""
    width = len(forest.names)

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(forest.probability(_matrix(rows, width)))

    return scored(inputs_of(forest, column_of))


def staged(df: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """(keep..., trees, score): the score after each number of trees, from one walk of the whole ensemble."""
    width = len(forest.names)

    @F.arrow_udf("array<double>")
    def margins(rows: pa.Array) -> pa.Array:
        x = _matrix(rows, width)
        sums = np.cumsum(forest.leaves(x), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(forest), pa.int32()), pa.array(sums.ravel()))

    d = df.select(*keep, F.posexplode(margins(inputs_of(forest))).alias("trees", "_m"))
    return d.select(*keep, (F.col("trees") + 1).alias("trees"), (1 / (1 + F.exp(-forest.sigmoid * F.col("_m")))).alias("score"))
