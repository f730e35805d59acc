"""Features: ranks, interactions, splines, scaling. Wide blocks are made in one projection each."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.nulls import divide, zero
from panelkiln.functions.ordering import cut, long_values, positions
from panelkiln.functions.ranks import rank_minmax_scaled, rank_pct_scaled
from panelkiln.sources.schema import INTERACTION_MARK


def rank_columns(panel: DataFrame, columns: list[str], by: str = "month", scale: str = "pct", low: float = -1.0, high: float = 1.0, spread: bool = False) -> DataFrame:
    """The panel with the columns replaced by their ranks; rows without date get none.

    A period is sorted in one task, all columns after one exchange. With `spread` a period of any size goes over all tasks, at
    the cost of a stored copy of the panel and a row for each value in the shuffles.
    """
    if spread:
        return _spread_ranks(panel, columns, by, scale, low, high)
    make = (lambda c: rank_pct_scaled(c, by, low, high)) if scale == "pct" else (lambda c: rank_minmax_scaled(c, by))
    return panel.select(*(F.when(F.col(by).isNotNull(), make(c)).alias(c) if c in columns else F.col(c) for c in panel.columns))


def _spread_ranks(panel: DataFrame, columns: list[str], by: str, scale: str, low: float, high: float) -> DataFrame:
    """Places of all values of all columns in one range exchange; equal values share the mean of their first and last place."""
    kept = cut(panel.withColumn("__id", F.monotonically_increasing_id()))
    placed = positions(long_values(kept.where(F.col(by).isNotNull()), columns, "__id", by), ["__column", by], ["__value", "__id"], "__place", "__size")
    ties = placed.groupBy(F.col("__column").alias("__c"), F.col(by).alias("__by"), F.col("__value").alias("__v")).agg(((F.min("__place") + F.max("__place")) / 2).alias("__rank"))
    ranked = placed.join(ties, (F.col("__column") == F.col("__c")) & (F.col(by) == F.col("__by")) & (F.col("__value") == F.col("__v")))
    n = F.col("__size")
    scaled = low + (high - low) * F.col("__rank") / n if scale == "pct" else F.when(n > 1, 2 * (F.col("__rank") - 1) / F.nullif(n - 1, F.lit(0)) - 1)
    wide = ranked.withColumn("__s", scaled).groupBy(F.col("__id").alias("__of")).agg(*(F.max(F.when(F.col("__column") == i, F.col("__s"))).alias(f"__r{i}") for i in range(len(columns))))
    joined = kept.join(wide, kept["__id"] == wide["__of"], "left")
    return joined.select(*(F.col(f"__r{columns.index(c)}").alias(c) if c in columns else kept[c] for c in panel.columns))


def interaction_names(columns: list[str], others: list[str], others_first: bool = False) -> list[str]:
    if others_first:
        return [f"{c}{INTERACTION_MARK}{o}" for o in others for c in columns]
    return [f"{c}{INTERACTION_MARK}{o}" for c in columns for o in others]


def macro_interactions(panel: DataFrame, characteristics: list[str], macros: list[str]) -> DataFrame:
    """The panel and all products of a characteristic and a macro."""
    return panel.select("*", *((F.col(c) * F.col(m)).alias(f"{c}{INTERACTION_MARK}{m}") for c in characteristics for m in macros))


def kronecker(panel: DataFrame, characteristics: list[str], macros: list[str], dummies: list[str], keys: list[str]) -> DataFrame:
    """Characteristics times a constant and all macros, and the dummies: P (M + 1) + K features beside the keys."""
    products = [(F.col(c) * F.col(m)).alias(f"{c}{INTERACTION_MARK}{m}") for c in characteristics for m in macros]
    return panel.select(*keys, *characteristics, *products, *dummies)


def industry_interactions(panel: DataFrame, characteristics: list[str], industry: str = "sic2", keys: tuple[str, ...] = ("permno", "month")) -> DataFrame:
    """Long form (keys, feature, value): for each row only the products with its own industry that are not 0."""
    if not characteristics:
        raise ValueError("no characteristics")
    name = F.concat(F.lit(f"{INTERACTION_MARK}{industry}_"), F.col(industry).cast("string"))
    entries = F.array(*(F.struct(F.concat(F.lit(c), name).alias("feature"), zero(c).alias("value")) for c in characteristics))
    return panel.where(F.col(industry).isNotNull()).select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").where("value <> 0")


def interaction_vector(panel: DataFrame, characteristics: list[str], industry: str = "sic2", output: str = "interactions") -> DataFrame:
    """The same block as sparse vectors, industry by industry; names stand in the column's metadata."""
    if not characteristics:
        raise ValueError("no characteristics")
    text = panel.withColumn("__industry", F.col(industry).cast("string"))
    filled = text.select(*text.columns, *(zero(c).alias(f"__{c}") for c in characteristics))
    steps = [
        StringIndexer(inputCol="__industry", outputCol="__code", stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCol="__code", outputCol="__hot", dropLast=True),
        VectorAssembler(inputCols=[f"__{c}" for c in characteristics], outputCol="__chars"), Interaction(inputCols=["__hot", "__chars"], outputCol=output),
    ]
    return Pipeline(stages=steps).fit(filled).transform(filled).select(*panel.columns, output)


def assemble(panel: DataFrame, dense: list[str], sparse: list[str] = (), output: str = "features") -> DataFrame:  # type: ignore[assignment]
    """Numeric columns and vector columns as one vector; missing numbers count as 0."""
    filled = panel.select(*panel.columns, *(zero(c).alias(f"__{c}") for c in dense))
    return VectorAssembler(inputCols=[*(f"__{c}" for c in dense), *sparse], outputCol=output).transform(filled).drop(*(f"__{c}" for c in dense))


def moments(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature (missing is 0; a deviation of 0 becomes 1), one aggregate."""
    sums = train.agg(*(f(zero(c)).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).head()
    return {c: (sums[f"m_{i}"] or 0.0, sums[f"s_{i}"] or 1.0) for i, c in enumerate(features)}


def standardize(panel: DataFrame, scale: dict[str, tuple[float, float]], center: bool = True) -> DataFrame:
    """Features less the training mean (if centred) over the training deviation."""
    return panel.select(*(((zero(c) - (scale[c][0] if center else 0.0)) / scale[c][1]).alias(c) if c in scale else F.col(c) for c in panel.columns))


def standardized_by(panel: DataFrame, features: list[str], train: str) -> DataFrame:
    """Standardised in one plan, with the statistics of the rows for which the expression `train` holds."""
    stats = panel.where(train).agg(*(f(zero(c)).alias(f"__{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = panel.crossJoin(F.broadcast(stats))  # one row on the right
    return wide.select(*(divide(zero(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(c) if c in features else F.col(c) for c in panel.columns))


def spline_basis(panel: DataFrame, features: list[str], knots: dict[str, list[float]]) -> DataFrame:
    """For each feature z the columns z and (z - knot)^2 for its knots; the constant belongs to the intercept."""
    return panel.select("*", *(F.pow(F.col(c) - k, F.lit(2.0)).alias(f"{c}_sq{i}") for c in features for i, k in enumerate(knots[c])))


def spline_knots(train: DataFrame, features: list[str], n: int = 3) -> dict[str, list[float]]:
    """Approximate inner quantiles of each feature on the training rows, one pass."""
    shares = [(i + 1) / (n + 1) for i in range(n)]
    row = train.agg(*(F.percentile_approx(c, shares).alias(f"k_{i}") for i, c in enumerate(features))).head()
    return {c: list(row[f"k_{i}"] or []) for i, c in enumerate(features)}


class FeatureBuilder:
    """Characteristics, macro interactions and industry interactions as one vector column."""

    def __init__(self, characteristics: list[str], macros: list[str] = (), dummies: list[str] = (), interactions: bool = True, industry: str | None = None):  # type: ignore[assignment]
        self.characteristics, self.macros, self.dummies, self.interactions, self.industry = list(characteristics), list(macros), list(dummies), interactions, industry
        self.block = 0
        self.dense = [*self.characteristics, *(interaction_names(self.characteristics, self.macros) if interactions else []), *self.dummies]

    @property
    def n_features(self) -> int:
        """Dense features and, once a panel with industries was transformed, those of its sparse block."""
        return len(self.dense) + self.block

    def transform(self, panel: DataFrame, output: str = "features") -> DataFrame:
        """All months at once: partitions take the place of month batches."""
        wide = macro_interactions(panel, self.characteristics, self.macros) if self.interactions else panel
        sparse = []
        if self.industry:
            wide, sparse = interaction_vector(wide, self.characteristics, self.industry, "__block"), ["__block"]
            self.block = int(wide.schema["__block"].metadata["ml_attr"]["num_attrs"])
        return assemble(wide, self.dense, sparse, output).select(*panel.columns, output)


def per_date_counts(panel: DataFrame, columns: list[str], by: str = "month") -> DataFrame:
    """Values of each column in each period."""
    return panel.where(F.col(by).isNotNull()).groupBy(by).agg(*(F.count(c).alias(c) for c in columns))


def expanding_mean(panel: DataFrame, value: str, date: str = "month", asset: str | None = "permno", output: str = "hist_mean") -> DataFrame:
    """Mean of all values up to and with the row's own date."""
    order = (Window.partitionBy(asset) if asset else Window.partitionBy(F.lit(1))).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(output, F.avg(value).over(order))
