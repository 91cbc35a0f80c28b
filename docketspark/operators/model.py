"""Models: training with staged validation, search, selection, calibration. Trees are scored by operators.trees."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import md5

from pyspark import inheritable_thread_target
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.columns import interpolated
from docketspark.operators import metrics
from docketspark.operators.boosting import boosted
from docketspark.operators.trees import Forest, probability
from docketspark.sources.store import stored


@dataclass
class Fitted:
    """A boosted-tree model cut to the trees kept, its validation metric, and each input's share of the gain."""

    forest: Forest
    features: list[str]
    trees: int
    validation_ap: float
    gains: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", probability(self.forest))

    def importance(self, top: int = 15) -> list[tuple[str, float]]:
        total = max(sum(self.gains), 1e-12)
        return sorted(zip(self.features, (100 * g / total for g in self.gains), strict=True), key=lambda x: -x[1])[:top]


def stopped(curve: Sequence[float], patience: int) -> int:
    """How many trees to keep: the first best of the rounds before `patience` of them brought no gain."""
    best = 0
    for i, ap in enumerate(curve):
        if ap > curve[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_trees(
    train: DataFrame, validation: DataFrame, features: list[str], rounds: int = 60, patience: int = 40, depth: int = 4, step: float = 0.1, least: int = 20,
    share: float = 1.0, bins: int = 63, seed: int = 42,
) -> Fitted:
    """Boosted trees, fitted once; the rounds end where `patience` of them bring no gain in the validation average precision, which is
    taken after every round. `least` rows make a leaf, each split sees a `share` of the inputs.

    Unknown inputs (null, NaN) are -1 in training, as they are in serving, and go the same way in scoring.
    """
    ended = lambda curve: len(curve) - stopped(curve, patience) >= patience
    forest, curve, gains = boosted(train, validation, features, rounds, ended, depth, step, least, share, bins, seed)
    kept = stopped(curve, patience)
    return Fitted(forest.prefix(kept), features, kept, curve[kept - 1], sum(gains[:kept]).tolist())


def draws(lists: dict[str, Sequence], n: int = 16, seed: int = 42) -> list[dict]:
    """`n` random settings, one value of each list by a hash of seed, draw and name; so a draw doesn't depend on the others."""
    return [{k: v[int(md5(f"{seed}/{i}/{k}".encode()).hexdigest()[:8], 16) % len(v)] for k, v in lists.items()} for i in range(n)]


#: The lists of the search: leaves (as depth), step, rows of a leaf, share of inputs, bins.
SEARCH = {"depth": (4, 5, 6, 7), "step": (0.03, 0.05, 0.1, 0.2), "least": (20, 50, 100, 300), "share": (0.6, 0.8, 1.0), "bins": (31, 63, 127)}


def random_search(
    table: DataFrame, is_train: Column, is_validation: Column, features: list[str], n: int = 16, seed: int = 42, at_once: int = 4, lists: dict[str, Sequence] = SEARCH, **options
) -> list[tuple[dict, Fitted]]:
    """`n` drawn settings, each fitted on one stored feature table, `at_once` as concurrent Spark jobs; best validation first, ties by draw.

    Only training and validation rows are looked at: the choice can't see a test.
    """
    kept = stored(table.select(*features, "y", is_train.alias("_train"), is_validation.alias("_validation")).where("_train or _validation"))
    train, validation = kept.where("_train").select(*features, "y"), kept.where("_validation").select(*features, "y")
    settings = draws(lists, n, seed)
    fit = inheritable_thread_target(train.sparkSession)(lambda s: fit_trees(train, validation, features, seed=seed, **(options | s)))
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(fit, settings))
    order = sorted(range(n), key=lambda i: (-done[i].validation_ap, i))
    return [(settings[i], done[i]) for i in order]


def run_variants(train: DataFrame, validation: DataFrame, variants: dict[str, list[str]], **options) -> dict[str, Fitted]:
    """The same training for several lists of inputs."""
    return {name: fit_trees(train, validation, features, **options) for name, features in variants.items()}


def ablation(train: DataFrame, validation: DataFrame, features: list[str], groups: dict[str, list[str]], **options) -> dict[str, Fitted]:
    """The full model and one without each group."""
    return run_variants(train, validation, {"all": features} | {f"without {g}": [f for f in features if f not in names] for g, names in groups.items()}, **options)


def select(results: dict[str, Fitted], quarantined: tuple[str, ...] = ()) -> str:
    """The variant with the best validation metric; variants with leaking inputs never count. Test metrics aren't known here."""
    allowed = {k: v for k, v in results.items() if not set(v.features) & set(quarantined)}
    if not allowed:
        raise ValueError("every variant uses a quarantined input")
    return max(allowed, key=lambda k: allowed[k].validation_ap)


@dataclass
class Calibration:
    grid: list[float]
    image: list[float]

    def apply(self, p: Column) -> Column:
        return interpolated(p, self.grid, self.image)


def fit_calibration(validation: DataFrame, points: int = 1000, score: str = "score") -> Calibration:
    """Isotonic regression of y on the score, sampled on an even grid between the lowest and highest score.

    For display only: it never ranks. Rows are counted per distinct score first, which gives the same curve.
    """
    counted = stored(metrics.blocks(validation, score))
    data = counted.select(F.col("score").cast("double").alias("features"), (F.col("pos") / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight"))
    fitted = IsotonicRegression(isotonic=True, weightCol="weight").fit(data)
    x, y = list(fitted.boundaries), list(fitted.predictions)
    low, high = x[0], x[-1] if x[-1] > x[0] else x[0] + 1e-9
    grid, image, at = [low + (high - low) * i / (points - 1) for i in range(points)], [], 0
    for g in grid:
        while at + 1 < len(x) and x[at + 1] <= g:
            at += 1
        if at + 1 >= len(x):
            image.append(y[-1])
        else:
            image.append(y[at] + (y[at + 1] - y[at]) * max(0.0, g - x[at]) / max(x[at + 1] - x[at], 1e-300))
    return Calibration(grid, image)
