"""The registered queries: each builds the panel from the given tables and applies one part of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.functions.nulls import divide, plain
from panelkiln.operators import evaluate as E
from panelkiln.operators import features as X
from panelkiln.operators import boosting, linear, neural, panel as P, trees, vector_models, walk_forward
from panelkiln.operators import portfolio as Q
from panelkiln.operators.splits import apply_rolling, apply_split, make_split, rolling_year_splits
from panelkiln.plans import runs
from panelkiln.sources import schema, tables
from panelkiln.sources.fixture import raw_tables

CHARACTERISTICS = ["n_lines", "disc", "qty", "tax", "retrate", "disp"]
MACROS = [f"macro_{m}" for m in schema.MACROS]
TARGET = "ret_excess_lead1"
KEYS = ["permno", "month"]
SPLIT = make_split(train_start="1995-01-01", train_end="1997-12-31", validation_start="1998-01-01", validation_end="1999-12-31", test_start="2000-01-01", test_end="2001-12-31")
TRAIN = "month <= DATE'1997-12-31'"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return P.build_panel(raw_tables(spark, d))


def _out(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all, if none are named) with doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*(plain(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in (columns or df.columns)))


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    return _of_panel(_panel(spark, d))


def _of_panel(panel: DataFrame) -> DataFrame:
    """Three fixed forecasts of the panel's rows, long: model a follows discounts, model b quantities, model c taxes."""
    panel = apply_split(panel, SPLIT, check=False)
    both = F.array(F.struct(F.lit("a").alias("model"), F.round((F.col("disc") - 0.05) * 0.8, 8).alias("forecast")), F.struct(F.lit("b").alias("model"), F.round((F.col("qty") - 25) / 100, 8).alias("forecast")), F.struct(F.lit("c").alias("model"), F.round((F.col("tax") - 0.04) * F.col("qty") / 10, 8).alias("forecast")))
    return panel.select(*KEYS, TARGET, "market_equity", "split", F.explode(both).alias("m")).select(*KEYS, TARGET, "market_equity", "split", "m.model", "m.forecast")


def _one(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d).where("model = 'a'").drop("model")


def _portfolios(spark: SparkSession, d: str) -> DataFrame:
    return _valued(_one(spark, d))


def _valued(forecasts: DataFrame) -> DataFrame:
    return Q.value_weighted(Q.assign_deciles(forecasts), TARGET, "market_equity")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return apply_split(_panel(spark, d), SPLIT, check=False).cache()


def _fitted(fit: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Forecasts of a model on validation and test rows."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        panel = _split(spark, d)
        model = fit(panel.where("split = 'train'"), panel.where("split = 'validation'"))
        return _out(model.predict(panel.where("split <> 'train'")), *KEYS, "split", "forecast")

    return query


def panel_build(spark, d):
    return _out(_panel(spark, d))


def panel_manifest(spark, d):
    found = tables.manifest(_panel(spark, d))
    return found.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in found.dtypes))


def sample_summary(spark, d):
    return _out(E.sample_summary(_panel(spark, d)))


def missing_rates(spark, d):
    families = {c: "trade" if c in ("n_lines", "qty", "disp") else "terms" for c in CHARACTERISTICS}
    return _out(E.missing_rates(raw_tables(spark, d)["stock_characteristics"], CHARACTERISTICS, families))


def target_distribution(spark, d):
    return _out(E.distribution(_panel(spark, d), [TARGET, "market_equity"]))


def rank_pct_scaled(spark, d):
    return _out(X.rank_columns(_panel(spark, d), CHARACTERISTICS), *KEYS, *CHARACTERISTICS)


def rank_minmax_scaled(spark, d):
    return _out(X.rank_columns(_panel(spark, d), CHARACTERISTICS, scale="minmax"), *KEYS, *CHARACTERISTICS)


def rank_pct_spread(spark, d):
    return _out(X.rank_columns(_panel(spark, d), CHARACTERISTICS, spread=True), *KEYS, *CHARACTERISTICS)


def rank_minmax_spread(spark, d):
    return _out(X.rank_columns(_panel(spark, d), CHARACTERISTICS, scale="minmax", spread=True), *KEYS, *CHARACTERISTICS)


def deciles_spread(spark, d):
    return _out(Q.assign_deciles(_one(spark, d), spread=True), *KEYS, "forecast", "bucket")


def size_groups_spread(spark, d):
    return P.by_size(_panel(spark, d), 3, spread=True).select(*KEYS, "side")


def ranked_characteristics(spark, d):
    return _out(tables.ranked(raw_tables(spark, d)["stock_characteristics"]))


def rank_guard(spark, d):
    raw = raw_tables(spark, d)["stock_characteristics"]
    states = ((n, tables.out_of_rank_range(df, CHARACTERISTICS)) for n, df in (("raw", raw), ("ranked", tables.ranked(raw))))
    a, b = (df.select(F.lit(n).alias("table_state"), "raw_values") for n, df in states)
    return a.unionByName(b)


def per_date_counts(spark, d):
    return X.per_date_counts(raw_tables(spark, d)["stock_characteristics"], CHARACTERISTICS, by="yyyymm")


def median_impute(spark, d):
    return _out(P.build_panel(raw_tables(spark, d), missing="median"), *KEYS, *CHARACTERISTICS)


def asof_release_lag(spark, d):
    raw = raw_tables(spark, d)
    returns = raw["stock_returns"].select("permno", "month", "ret")
    quarterly = returns.where(F.month("month") % 3 == 0).select("permno", "month", F.col("ret").alias("q_ret"))
    annual = returns.where(F.month("month") == 12).select("permno", "month", F.col("ret").alias("a_ret"))
    lagged = P.release_lag(P.release_lag(returns, quarterly, ["q_ret"], 4), annual, ["a_ret"], 6)
    return _out(lagged, *KEYS, "q_ret_lag4", "a_ret_lag6")


def macro_interactions(spark, d):
    wide = X.macro_interactions(_panel(spark, d), CHARACTERISTICS, MACROS)
    return _out(wide, *KEYS, *X.interaction_names(CHARACTERISTICS, MACROS))


def kronecker_features(spark, d):
    panel = P.one_hot(_panel(spark, d), codes=list(range(25)))
    wide = X.kronecker(panel, CHARACTERISTICS, MACROS, [f"sic2_{k}" for k in range(25)], KEYS)
    return _out(wide)


def industry_interactions_long(spark, d):
    return _out(X.industry_interactions(_panel(spark, d), CHARACTERISTICS))


def interaction_vector(spark, d):
    """Entries of the sparse vectors that are not 0, by row."""
    from pyspark.ml.functions import vector_to_array

    wide = X.interaction_vector(_panel(spark, d), CHARACTERISTICS)
    values = vector_to_array("interactions")
    return _out(wide.select(*KEYS, F.size(F.filter(values, lambda v: v != 0)).cast("long").alias("n_nonzero"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total")))


def spline_basis(spark, d):
    wide = X.spline_basis(_panel(spark, d), ["qty"], {"qty": [20.0, 25.0, 30.0]})
    return _out(wide, *KEYS, "qty", "qty_sq0", "qty_sq1", "qty_sq2")


def standardized_features(spark, d):
    return _out(X.standardized_by(_panel(spark, d), CHARACTERISTICS, TRAIN), *KEYS, *CHARACTERISTICS)


def scaled_features(spark, d):
    panel = _panel(spark, d)
    scaled = X.standardize(panel, X.moments(panel.where(TRAIN), CHARACTERISTICS), center=False)
    return _out(scaled, *KEYS, *CHARACTERISTICS)


def market_equity_sic2(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (-F.col("l_extendedprice")).alias("prc"), F.col("l_quantity").alias("shrout"), F.col("l_partkey").alias("siccd"))
    return _out(items.select("l_orderkey", "l_linenumber", P.market_equity().alias("me"), P.sic2().alias("sic2")))


def fixed_split_counts(spark, d):
    return apply_split(_panel(spark, d), SPLIT, check=False).groupBy("split").count().withColumnRenamed("count", "n_rows")


def rolling_split_counts(spark, d):
    folds = apply_rolling(_panel(spark, d), rolling_year_splits(1995, 2001, train=3, validation=2, test=1))
    return folds.groupBy("fold", "split").agg(F.count("*").alias("n_rows"))


def expanding_split_counts(spark, d):
    folds = apply_rolling(_panel(spark, d), rolling_year_splits(1995, 2001, train=3, validation=1, test=1, expanding=True))
    return folds.groupBy("fold", "split").agg(F.count("*").alias("n_rows"))


def oos_r2_by_model(spark, d):
    return _out(_forecasts(spark, d).groupBy("model", "split").agg(F.count("*").alias("n_rows"), E.oos_r2(TARGET, "forecast").alias("r2")))


def mse_mae(spark, d):
    return _out(_forecasts(spark, d).groupBy("model").agg(E.mse(TARGET, "forecast").alias("mse"), E.mae(TARGET, "forecast").alias("mae")))


def monthly_ic(spark, d):
    return _out(E.information_coefficient(_forecasts(spark, d), TARGET, "forecast", by=("model",)))


def calibration(spark, d):
    return _out(E.calibration(_forecasts(spark, d), TARGET, "forecast", by=("model",)))


def calibrated_evaluation(spark, d):
    both = E.calibrated(_forecasts(spark, d), TARGET, "forecast", by=("model",)).where("split = 'test'")
    return _out(both.groupBy("model").agg(E.oos_r2(TARGET, "calibrated").alias("r2"), E.mse(TARGET, "calibrated").alias("mse")))


def full_evaluation(spark, d):
    return _out(runs.evaluate_on_test(_forecasts(spark, d), TARGET)["metrics"])


def model_metrics(spark, d):
    return _out(runs.model_metrics(_forecasts(spark, d), TARGET))


def stacked_predictions(spark, d):
    panel = _split(spark, d)
    fits = {"ols": lambda t, _, f, y: linear.ols(linear.gram(t, f, y)), "ridge": lambda t, _, f, y: linear.ridge(linear.gram(t, f, y), 10.0)}
    return _out(runs.run_models(panel, fits, ["disc"], TARGET)[0])


def dm_pooled(spark, d):
    wide = _forecasts(spark, d).groupBy(*KEYS, TARGET).pivot("model", ["a", "b"]).agg(F.first("forecast"))
    return _out(wide.select(E.loss_difference(TARGET, "a", "b").alias("x")).agg(F.count("x").alias("n"), F.avg("x").alias("mean_diff"), E.t_stat(F.col("x")).alias("dm_stat")))


def monthly_error_difference(spark, d):
    return _out(E.dm_pairs(_forecasts(spark, d), TARGET))


def dm_newey_west(spark, d):
    pairs = E.dm_pairs(_forecasts(spark, d).where("model IN ('a', 'b')"), TARGET)
    return _out(E.newey_west(pairs, "diff", lags=12))


def dm_matrix(spark, d):
    return _out(E.dm_matrix(_forecasts(spark, d), TARGET, lags=3))


def forecast_deciles(spark, d):
    return _out(Q.assign_deciles(_one(spark, d)), *KEYS, "forecast", "bucket")


def vw_returns(spark, d):
    return _out(_portfolios(spark, d))


def long_short(spark, d):
    return _out(Q.long_short(_portfolios(spark, d)))


def decile_performance(spark, d):
    return _out(Q.decile_performance(_portfolios(spark, d)))


def decile_monotonicity(spark, d):
    return _out(Q.monotonicity(Q.decile_performance(_portfolios(spark, d))))


def turnover(spark, d):
    return _out(Q.turnover(Q.assign_deciles(_one(spark, d))))


def sharpe(spark, d):
    return _out(Q.long_short(_portfolios(spark, d)).agg(Q.sharpe(F.col("long_short")).alias("sharpe")))


def r2_to_sharpe(spark, d):
    one = _one(spark, d)
    both = one.agg(E.oos_r2(TARGET, "forecast").alias("r2"), Q.sharpe(F.col(TARGET), 1).alias("sr"))
    return _out(both.select("r2", "sr", E.r2_to_sharpe(F.col("sr"), F.greatest("r2", F.lit(0.001))).alias("reachable")))


def timing_strategy(spark, d):
    monthly = _one(spark, d).groupBy("month").agg(F.avg("forecast").alias("f"), F.avg(TARGET).alias("r"))
    held = monthly.select("month", Q.timing(F.col("f"), 50.0).alias("position"), "r")
    return _out(held.agg(Q.sharpe(F.col("position") * F.col("r")).alias("timed"), Q.sharpe(F.col("r")).alias("held"), F.avg("position").alias("mean_position")))


def positive_forecasts(spark, d):
    return _out(_one(spark, d).select(*KEYS, Q.positive_part(F.col("forecast")).alias("forecast")))


def hist_mean_benchmark(spark, d):
    return _out(X.expanding_mean(_panel(spark, d), "ret_excess"), *KEYS, "hist_mean")


def sign_restricted_forecast(spark, d):
    rows = E.sign_restricted(_panel(spark, d), TARGET, "disc", 1)
    return _out(rows, *KEYS, "hist_mean", "restricted")


def _fixed_linear() -> linear.Linear:
    return linear.Linear(("disc", "qty", "tax"), (0.8, 0.01, -0.5), -0.2)


def drop_importance_linear(spark, d):
    model = _fixed_linear()
    return _out(E.drop_importance(model.predict(_panel(spark, d)), TARGET, "forecast", model.terms()))


def group_importance(spark, d):
    model = _fixed_linear()
    t = model.terms()
    return _out(E.drop_importance(model.predict(_panel(spark, d)), TARGET, "forecast", {"terms": t["disc"] + t["tax"], "trade": t["qty"]}))


def network_importance(spark, d):
    """By feature, of a network without hidden layers after one step."""
    panel = _split(spark, d)
    parts = (panel.where(F.col("split") == p) for p in ("train", "validation"))
    model = neural.train_network(*parts, ["disc", "qty"], TARGET, [], epochs=1, rate=0.05, batch=10**9)
    return _out(E.ablation_importance(model, panel, TARGET))


def boosted_importance(spark, d):
    """By group, of a stage of boosting that only one feature can split."""
    panel = _split(spark, d).withColumn("still", F.lit(1.0))
    model = boosting.boosted_huber(panel.where("split = 'train'"), ["n_lines", "still"], TARGET, stages=1, rate=0.5, quantile=1.0)
    return _out(E.ablation_importance(model, panel, TARGET, {"trade": ["n_lines"], "none": ["still"], "both": ["n_lines", "still"]}))


def ssd_importance(spark, d):
    return _out(linear.ssd_importance(_fixed_linear(), _panel(spark, d)))


def top_bottom_subsample(spark, d):
    return P.by_size(_panel(spark, d), 3).select(*KEYS, "side")


def regime_subsample(spark, d):
    return P.by_regime(_panel(spark, d)).groupBy("regime").agg(F.count("*").alias("n_rows"), F.countDistinct("month").alias("n_months"))


def period_sector_subsample(spark, d):
    marked = P.by_sector(P.by_period(_panel(spark, d)).withColumn("sic2", F.col("sic2") + 50))
    return marked.groupBy("period", "sector").agg(F.count("*").alias("n_rows"))


def panel_head(spark, d):
    return _out(P.build_panel(raw_tables(spark, d), rows=50), *KEYS, *CHARACTERISTICS)


def duplicate_keys(spark, d):
    return schema.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), "l_partkey", "l_suppkey")


def loss_table(spark, d):
    u = F.col(TARGET) - F.col("forecast")
    return _out(_forecasts(spark, d).groupBy("model").agg(F.avg(u * u).alias("mse"), F.avg(P.huber(u, 0.5)).alias("huber"), divide(E.weighted_loss(TARGET, "forecast", "market_equity"), F.avg("market_equity")).alias("weighted")))


def ols_forecast_2f(spark, d):
    return _fitted(lambda train, _: linear.ols(linear.gram(train, ["disc", "qty"], TARGET)))(spark, d)


def ridge_forecast_2f(spark, d):
    return _fitted(lambda train, _: linear.ridge(linear.gram(train, ["disc", "qty"], TARGET), 100.0))(spark, d)


def wls_forecast_1f(spark, d):
    return _fitted(lambda train, _: linear.ols(linear.gram(train, ["disc"], TARGET, "market_equity")))(spark, d)


def ridge_grid_1f(spark, d):
    panel = _split(spark, d)
    _, curve = linear.ridge_grid(linear.gram(panel.where("split = 'train'"), ["disc"], TARGET), panel.where("split = 'validation'"), TARGET)
    return _out(curve)


def _interaction_panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All, training and validation rows with the sparse block of characteristics by industry."""
    panel = X.interaction_vector(_split(spark, d), CHARACTERISTICS)
    return panel, panel.where("split = 'train'"), panel.where("split = 'validation'")


def ridge_sparse_forecast(spark, d):
    panel, train, _ = _interaction_panel(spark, d)
    model = vector_models.ridge_of_vectors(train, "interactions", TARGET, (10.0,))[0]
    return _out(model.predict(panel.where("split <> 'train'")), *KEYS, "split", "forecast")


def ridge_sparse_conjugate(spark, d):
    """The same forecasts by conjugate gradients."""
    panel, train, _ = _interaction_panel(spark, d)
    model = vector_models.conjugate_ridge(train, "interactions", TARGET, (10.0,))[0][0]
    return _out(model.predict(panel.where("split <> 'train'")), *KEYS, "split", "forecast")


def ridge_sparse_grid(spark, d):
    _, train, validation = _interaction_panel(spark, d)
    return _out(vector_models.ridge_grid_of_vectors(train, validation, "interactions", TARGET)[1])


def _walked(spark: SparkSession, d: str) -> DataFrame:
    """What walk-forward fits read twice: for the sums by year and for the forecasts."""
    return tables.stored(_panel(spark, d).select(*KEYS, "disc", "qty", TARGET))


def walk_forward_ols(spark, d):
    splits = rolling_year_splits(1995, 2001, train=2, validation=1, test=1)
    return _out(walk_forward.walk_forward(_walked(spark, d), splits, ["disc", "qty"], TARGET)[0], *KEYS, "fold", "forecast")


def walk_forward_ridge(spark, d):
    """Expanding training windows; each fold takes the penalty that its validation year prefers."""
    splits = rolling_year_splits(1995, 2001, train=2, validation=1, test=1, expanding=True)
    return _out(walk_forward.walk_forward(_walked(spark, d), splits, ["disc", "qty"], TARGET, linear.RIDGE_GRID)[0], *KEYS, "fold", "alpha", "forecast")


def walk_forward_choices(spark, d):
    splits = rolling_year_splits(1995, 2001, train=2, validation=1, test=1, expanding=True)
    return _out(walk_forward.walk_forward(_panel(spark, d), splits, ["disc", "qty"], TARGET, linear.RIDGE_GRID)[1])


def ols3_forecast(spark, d):
    return _fitted(lambda train, _: linear.ols(linear.gram(train, ["disc", "qty", "tax"], TARGET)))(spark, d)


def pcr(spark, d):
    return _fitted(lambda train, _: linear.pcr(linear.gram(train, CHARACTERISTICS, TARGET), 3))(spark, d)


def pls(spark, d):
    return _fitted(lambda train, _: linear.pls(linear.gram(train, CHARACTERISTICS, TARGET), 2))(spark, d)


def pcr_2f(spark, d):
    """One of two directions."""
    return _fitted(lambda train, _: linear.pcr(linear.gram(train, ["disc", "qty"], TARGET), 1))(spark, d)


def glm_spline_1f(spark, d):
    return _fitted(lambda train, _: runs.glm_spline(train, ["qty"], TARGET, penalty=0.002, knots={"qty": [25.0]}))(spark, d)


def regression_tree_1f(spark, d):
    return _fitted(lambda train, _: trees.regression_tree(train, ["n_lines"], TARGET, depth=2, leaf=100))(spark, d)


def random_forest_1f(spark, d):
    """Trees that see all rows and features are all the same tree."""
    return _fitted(lambda train, _: trees.random_forest(train, ["n_lines"], TARGET, numTrees=3, maxDepth=2, bootstrap=False))(spark, d)


def random_forest_grid_1f(spark, d):
    panel = _split(spark, d)
    grid = [{"numTrees": 2, "maxDepth": k, "minInstancesPerNode": 100, "featureSubsetStrategy": "all", "subsamplingRate": 1.0, "bootstrap": False} for k in (1, 2)]
    return _out(trees.random_forest_grid(panel.where("split = 'train'"), panel.where("split = 'validation'"), ["n_lines"], TARGET, grid)[1])


def gbrt_squares_1f(spark, d):
    """One stage that clips nothing: boosting of squared errors."""
    return _fitted(lambda train, _: boosting.boosted_huber(train, ["n_lines"], TARGET, stages=1, rate=0.5, quantile=1.0))(spark, d)


def ensemble_mean(spark, d):
    forecasts = _forecasts(spark, d)
    return _out(runs.seed_ensemble([forecasts.where(F.col("model") == m).select(*KEYS, "forecast") for m in "abc"]))


def enet_1f(spark, d):
    """A threshold that no residual reaches: the elastic net of squared errors."""
    return _fitted(lambda train, _: linear.elastic_net_huber(train, ["disc"], TARGET, alpha=0.02, xi=1e6, tolerance=1e-14))(spark, d)


def enet_huber(spark, d):
    return _fitted(lambda train, _: linear.elastic_net_huber(train, CHARACTERISTICS, TARGET))(spark, d)


def glm_spline(spark, d):
    return _fitted(lambda train, _: runs.glm_spline(train, CHARACTERISTICS, TARGET))(spark, d)


def regression_tree(spark, d):
    return _fitted(lambda train, _: trees.regression_tree(train, CHARACTERISTICS, TARGET, depth=4, leaf=20))(spark, d)


def random_forest(spark, d):
    return _fitted(lambda train, _: trees.random_forest(train, CHARACTERISTICS, TARGET, numTrees=20, maxDepth=4, minInstancesPerNode=20))(spark, d)


def random_forest_grid(spark, d):
    panel = _split(spark, d)
    grid = [{**g, "numTrees": 10} for g in trees.FOREST_GRID if g["maxDepth"] < 6]
    return _out(trees.random_forest_grid(panel.where("split = 'train'"), panel.where("split = 'validation'"), CHARACTERISTICS, TARGET, grid)[1])


def random_forest_preset(spark, d):
    return _fitted(lambda train, _: trees.random_forest(train, CHARACTERISTICS, TARGET))(spark, d)


def random_forest_grid_preset(spark, d):
    panel = _split(spark, d)
    return _out(trees.random_forest_grid(panel.where("split = 'train'"), panel.where("split = 'validation'"), CHARACTERISTICS, TARGET)[1])


def gbrt_huber(spark, d):
    return _fitted(lambda train, _: boosting.boosted_huber(train, CHARACTERISTICS, TARGET, stages=100, rate=0.05))(spark, d)


def _network(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A network at its preset's widths, batch and number of epochs."""
    return _fitted(lambda train, validation: neural.train_network(train, validation, CHARACTERISTICS, TARGET, neural.WIDTHS[name]))


nn1, nn2, nn3, nn4, nn5 = (_network(name) for name in neural.WIDTHS)
nn = nn3


def nn_linear_step(spark, d):
    """A network without hidden layers after one step over all rows."""
    return _fitted(lambda train, validation: neural.train_network(train, validation, ["disc", "qty"], TARGET, [], epochs=1, rate=0.05, batch=10**9))(spark, d)


def seed_ensemble(spark, d):
    panel = _split(spark, d)
    def run(seed: int) -> DataFrame:
        return trees.random_forest(panel.where("split = 'train'"), CHARACTERISTICS, TARGET, seed=seed, numTrees=5, maxDepth=3, minInstancesPerNode=20).predict(panel.where("split = 'test'")).select(*KEYS, "forecast")

    return _out(runs.seed_ensemble([run(1), run(2)]))


def decile_table(spark, d):
    """The flagship: ranked features, a linear forecast fitted on the training years, value-weighted deciles of test months."""
    panel = X.rank_columns(_panel(spark, d), CHARACTERISTICS)
    split = apply_split(panel, SPLIT, check=False).cache()
    model = linear.ols(linear.gram(split.where("split = 'train'"), ["disc", "qty"], TARGET))
    return _out(Q.value_weighted(Q.assign_deciles(model.predict(split.where("split = 'test'"))), TARGET, "market_equity"))


_NAMES = """panel_build panel_manifest sample_summary missing_rates target_distribution rank_pct_scaled rank_minmax_scaled
rank_pct_spread rank_minmax_spread deciles_spread size_groups_spread ranked_characteristics
rank_guard per_date_counts median_impute asof_release_lag macro_interactions kronecker_features industry_interactions_long interaction_vector spline_basis
standardized_features scaled_features market_equity_sic2 fixed_split_counts rolling_split_counts expanding_split_counts oos_r2_by_model mse_mae monthly_ic calibration
calibrated_evaluation full_evaluation model_metrics stacked_predictions dm_pooled monthly_error_difference dm_newey_west dm_matrix forecast_deciles vw_returns
long_short decile_performance decile_monotonicity turnover sharpe r2_to_sharpe timing_strategy positive_forecasts hist_mean_benchmark
sign_restricted_forecast drop_importance_linear group_importance network_importance boosted_importance ssd_importance top_bottom_subsample regime_subsample
period_sector_subsample panel_head duplicate_keys loss_table ols_forecast_2f ridge_forecast_2f wls_forecast_1f ridge_grid_1f ridge_sparse_forecast ridge_sparse_conjugate ridge_sparse_grid
walk_forward_ols walk_forward_ridge walk_forward_choices ols3_forecast pcr
pcr_2f glm_spline_1f regression_tree_1f random_forest_1f random_forest_grid_1f gbrt_squares_1f ensemble_mean enet_1f pls enet_huber glm_spline regression_tree random_forest random_forest_preset random_forest_grid random_forest_grid_preset gbrt_huber nn nn1 nn2 nn4 nn5 nn_linear_step seed_ensemble decile_table""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}
