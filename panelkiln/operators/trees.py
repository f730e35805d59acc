"""Tree models: single and deep trees on Spark's own learners, forests on `forest`. Boosting for the Huber loss is in `boosting`."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.operators import forest
from panelkiln.operators.evaluate import oos_r2
from panelkiln.operators.features import assemble

#: Presets of the forest: trees, depth, least rows of a leaf, features tried, share of rows.
FOREST = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 100, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}
FOREST_GRID = [{"numTrees": 300, "maxDepth": d, "minInstancesPerNode": 1, "featureSubsetStrategy": s, "subsamplingRate": 0.5, "bootstrap": True} for d in (2, 4, 6) for s in ("sqrt", "50")]


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return assemble(df, features, output="__features")


class Forecaster:
    """A fitted Spark model with the assembling of its inputs."""

    def __init__(self, model, features: list[str]):
        self.model, self.features = model, features

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        done = self.model.transform(_vector(df, self.features))
        return done.withColumn(output, F.col("prediction")).drop("prediction", "__features")


def _fit(learner, train: DataFrame, features: list[str], target: str) -> Forecaster:
    rows = _vector(train.where(F.col(target).isNotNull()), features).select("__features", F.col(target).alias("__label"))
    return Forecaster(learner.setFeaturesCol("__features").setLabelCol("__label").fit(rows), features)


def regression_tree(train: DataFrame, features: list[str], target: str, depth: int = 6, leaf: int = 100, seed: int = 1) -> Forecaster:
    return _fit(DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, seed=seed), train, features, target)


def _held(settings: dict) -> bool:
    """Whether `forest` grows such trees; deeper ones and other settings are left to Spark's learner."""
    return set(settings) <= set(forest.SETTINGS) and settings["maxDepth"] <= forest.DEEPEST


def random_forest(train: DataFrame, features: list[str], target: str, seed: int = 1, **settings) -> forest.Forest | Forecaster:
    own = FOREST | settings
    if _held(own):
        return forest.grown(train, features, target, [own], seed)[0]
    if str(own["featureSubsetStrategy"]).isdigit():  # not more than there are
        own["featureSubsetStrategy"] = str(min(int(own["featureSubsetStrategy"]), len(features)))
    return _fit(RandomForestRegressor(seed=seed, **own), train, features, target)


def random_forest_grid(train: DataFrame, validation: DataFrame, features: list[str], target: str, grid: list[dict] | None = None, seed: int = 1) -> tuple[forest.Forest | Forecaster, DataFrame]:
    """The best forest by R2 on validation rows (the first of equals), and the curve.

    Settings that differ in depth only are one forest, grown to the greatest depth: its upper levels are the forests of lesser depth.
    """
    grid = [FOREST | settings for settings in (FOREST_GRID if grid is None else grid)]
    groups: dict[tuple, list[int]] = {}
    for i, settings in enumerate(grid):
        if _held(settings):
            groups.setdefault(tuple(sorted((k, str(v)) for k, v in settings.items() if k != "maxDepth")), []).append(i)
    fits, r2 = {}, {}
    if groups:
        grown = forest.grown(train, features, target, [max((grid[i] for i in own), key=lambda s: s["maxDepth"]) for own in groups.values()], seed)
        places = [i for own in groups.values() for i in own]
        depths = [[grid[i]["maxDepth"] for i in own] for own in groups.values()]
        fits = {i: f.of_depth(grid[i]["maxDepth"]) for f, own in zip(grown, groups.values(), strict=True) for i in own}
        r2 = dict(zip(places, forest.at_depths(validation, target, list(zip(grown, depths, strict=True))).agg(*(oos_r2("y", f"f{k}") for k in range(len(places)))).head(), strict=True))
    for i, settings in enumerate(grid):
        if i not in fits:
            fits[i] = random_forest(train, features, target, seed, **settings)
            r2[i] = fits[i].predict(validation).agg(oos_r2(target, "forecast")).head()[0]
    curve = [(i, int(s["maxDepth"]), str(s["featureSubsetStrategy"]), r2[i]) for i, s in enumerate(grid)]
    best = max(curve, key=lambda r: (r[3] is not None, r[3] or 0.0, -r[0]))[0]
    return fits[best], train.sparkSession.createDataFrame(curve, "grid_index int, max_depth int, max_features string, validation_r2 double")
