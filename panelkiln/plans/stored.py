"""Registered queries of the sources, sinks and adapters: what is written is read back, and results are those of what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.operators import evaluate as E
from panelkiln.operators import features as X
from panelkiln.operators import linear
from panelkiln.operators import panel as P
from panelkiln.operators import portfolio as Q
from panelkiln.plans import oracles as O
from panelkiln.plans import queries as R
from panelkiln.plans import runs, stages
from panelkiln.sources import schema, tables
from panelkiln.sources.fixture import raw_tables

CODES = list(range(25))
DUMMIES = [f"sic2_{k}" for k in CODES]
ROLES = ("characteristics", "macros", "dummies")


def _with_dummies(spark: SparkSession, d: str) -> DataFrame:
    return P.one_hot(R._panel(spark, d), codes=CODES)


def raw_tables_read_back(spark, d):
    folder, raw = tables.shared_folder(spark), raw_tables(spark, d)
    for name, df in raw.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return R._out(P.build_panel(tables.read_raw(spark, folder, schema.raw_schemas(R.CHARACTERISTICS))))


def bucketed_panel_build(spark, d):
    """The panel from raw tables that were stored by asset once; the catalog forgets them, the files stay for the result."""
    folder = tables.shared_folder(spark)
    prefix = f"raw_{folder.rsplit('/', 1)[-1]}"
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    tables.write_bucketed(raw_tables(spark, d), prefix, folder, buckets=8)
    panel = P.build_panel(tables.read_bucketed(spark, prefix))
    for name in tables.RAW_TABLES:
        spark.sql(f"DROP TABLE {prefix}_{name}")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
    return R._out(panel)


def panel_read_back(spark, d):
    path = f"{tables.shared_folder(spark)}/panel"
    tables.write_panel(R._panel(spark, d), path)
    return R._out(tables.load_panel(spark, path).drop("year"))


def results_read_back(spark, d):
    folder, forecasts = tables.shared_folder(spark), R._forecasts(spark, d)
    metrics = runs.model_metrics(forecasts, R.TARGET)
    tables.write_results(forecasts, metrics, folder)
    counts = spark.read.parquet(f"{folder}/predictions").groupBy("model").agg(F.count("*").alias("n_predictions"))
    return R._out(spark.read.option("header", True).schema(metrics.schema).csv(f"{folder}/metrics").join(counts, "model"))


def family_results_read_back(spark, d):
    """The decile table of the test rows, with the mean squared error that the family's metrics hold."""
    folder, forecasts = tables.shared_folder(spark), R._forecasts(spark, d)
    done = runs.evaluate_on_test(forecasts, R.TARGET)
    tables.write_family_results("fixed", done["metrics"], done["deciles"], done["predictions"], folder)
    deciles = spark.read.option("header", True).schema(done["deciles"].schema).csv(f"{folder}/fixed_deciles")
    metrics = spark.read.schema(done["metrics"].schema).json(f"{folder}/fixed_metrics").select("model", "mse_raw")
    return R._out(deciles.join(metrics, "model"))


def evaluation_spread(spark, d):
    return R._out(runs.evaluate_on_test(R._forecasts(spark, d), R.TARGET)["spread"])


def reports_read_back(spark, d):
    folder, summary = tables.shared_folder(spark), E.sample_summary(R._panel(spark, d))
    tables.write_reports({"sample_summary": summary}, folder)
    return R._out(spark.read.option("header", True).schema(summary.schema).csv(f"{folder}/sample_summary"))


def manifest_read_back(spark, d):
    path, panel = f"{tables.shared_folder(spark)}/manifest", _with_dummies(spark, d)
    tables.write_manifest(panel, path, interactions=X.industry_interactions(panel, R.CHARACTERISTICS))
    found = tables.read_manifest(spark, path, panel)
    lists = [F.lit(",".join(found[k])).alias(k) for k in ROLES]
    return spark.read.json(path).select("rows", "interaction_features", "interaction_nonzero", *lists)


def interactions_read_back(spark, d):
    path = f"{tables.shared_folder(spark)}/interactions"
    tables.write_interactions(X.interaction_vector(R._panel(spark, d), R.CHARACTERISTICS), path)
    values = vector_to_array("interactions")
    count = F.size(F.filter(values, lambda v: v != 0)).cast("long")
    return R._out(spark.read.parquet(path).select(*R.KEYS, count.alias("n_nonzero"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total")))


def feature_order(spark, d):
    """Place, role and mean of every feature, in the order in which models get them."""
    panel = _with_dummies(spark, d)
    role = {c: k for k, names in schema.roles(panel).items() for c in names}
    entries = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.lit(role[c]).alias("role"), F.col(c).cast("double").alias("value")) for i, c in enumerate(schema.select_features(panel))]
    long = panel.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return R._out(long.groupBy("place", "feature", "role").agg(F.avg("value").alias("mean")))


def ridge_choice(spark, d):
    return R._fitted(lambda train, validation: linear.ridge_grid(linear.gram(train, ["disc"], R.TARGET), validation, R.TARGET)[0])(spark, d)


def _vector_sums(df: DataFrame) -> DataFrame:
    values = vector_to_array("features")
    return R._out(df.select(*R.KEYS, F.size(values).alias("n_features"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total")))


def dense_sparse_vector(spark, d):
    return _vector_sums(X.assemble(X.interaction_vector(R._panel(spark, d), R.CHARACTERISTICS), R.CHARACTERISTICS, ["interactions"]))


def built_features(spark, d):
    return _vector_sums(X.FeatureBuilder(R.CHARACTERISTICS, R.MACROS, DUMMIES, industry="sic2").transform(_with_dummies(spark, d)))


def estimator_adapter(spark, d):
    return R._fitted(lambda train, _: runs.SparkEstimator(LinearRegression(solver="normal"), ["disc", "qty"]).fit(train, R.TARGET))(spark, d)


def estimator_on_vectors(spark, d):
    """A vector column among the features."""
    panel = X.assemble(R._split(spark, d), ["qty"], output="packed")
    model = runs.SparkEstimator(LinearRegression(solver="normal"), ["disc", "packed"]).fit(panel.where("split = 'train'"), R.TARGET)
    return R._out(model.predict(panel.where("split <> 'train'")), *R.KEYS, "split", "forecast")


def pipeline_saved_forecast(spark, d):
    """A family fitted inside a pipeline, saved and read back."""
    panel, path = R._split(spark, d), f"{tables.shared_folder(spark)}/pipeline"
    Pipeline(stages=[stages.PanelRegressor(family="ols", features=["disc", "qty"], target=R.TARGET, split="split")]).fit(panel).save(path)
    return R._out(PipelineModel.load(path).transform(panel.where("split <> 'train'")), *R.KEYS, "split", "forecast")


def all_reports_read_back(spark, d):
    """The six reports, written and read back: rows of each and the sum of one measure."""
    folder, panel, model = tables.shared_folder(spark), tables.stored(R._panel(spark, d)), R._fixed_linear()
    evaluated = runs.evaluate_on_test(R._of_panel(panel), R.TARGET)
    forecasts = evaluated["predictions"]
    portfolios = R._valued(forecasts.where("model = 'a'").drop("model"))
    reports = {
        "sample_summary": E.sample_summary(panel), "model_r2": runs.model_metrics(forecasts, R.TARGET), "model_dm_tests": E.dm_matrix(forecasts, R.TARGET, lags=3),
        "decile_portfolios": Q.decile_performance(portfolios), "long_short_performance": evaluated["spread"],
        "variable_importance": E.drop_importance(model.predict(panel), R.TARGET, "forecast", model.terms()),
    }
    reports = {n: R._out(df) for n, df in reports.items()}
    tables.write_reports(reports, folder)
    out = None
    for name, measure in _REPORT_MEASURES.items():
        found = spark.read.option("header", True).schema(reports[name].schema).csv(f"{folder}/{name}")
        row = found.agg(F.lit(name).alias("report"), F.count("*").alias("n_rows"), F.sum(measure).alias("total"))
        out = row if out is None else out.unionByName(row)
    return R._out(out)


_REPORT_MEASURES = {
    "sample_summary": "mean_assets", "model_r2": "test_oos_r2", "model_dm_tests": "dm_stat", "decile_portfolios": "mean_return", "long_short_performance": "mean_spread", "variable_importance": "importance",
}


def custom_function(spark, d):
    def fit(train, validation, test, target, features, config, seed):
        model = linear.ridge(linear.gram(train, features, target), config["alpha"])
        return model.predict(validation.unionByName(test)), None

    return R._out(runs.run_custom(fit, R._split(spark, d), ["disc", "qty"], R.TARGET, {"alpha": 100.0})[0], *R.KEYS, "split", "forecast")


def rescored_importance(spark, d):
    return R._out(E.rescored_importance(R._fixed_linear(), R._panel(spark, d), R.TARGET, ["disc", "qty", "tax"]))


def _test_portfolios() -> str:
    return (
        "mplaced AS (SELECT *, row_number() OVER (PARTITION BY model, month ORDER BY forecast, permno) AS place, count(*) OVER (PARTITION BY model, month) AS n FROM forecasts WHERE split = 'test'), "
        "mdeciles AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, CAST(((place - 1) * 10 + n - 2) // (n - 1) AS INTEGER)) END AS bucket FROM mplaced), "
        "mreturns AS (SELECT model, month, bucket, sum(ret_excess_lead1 * market_equity) / sum(market_equity) AS portfolio_return FROM mdeciles WHERE bucket IS NOT NULL GROUP BY 1, 2, 3), "
        "mspread AS (SELECT model, month, max(portfolio_return) FILTER (bucket = 10) - max(portfolio_return) FILTER (bucket = 1) AS long_short FROM mreturns GROUP BY 1, 2), "
        "merror AS (SELECT model, " + O._MSE.format("forecast") + " AS mse_raw FROM forecasts WHERE split = 'test' GROUP BY 1)"
    )


def _order_sql() -> str:
    listed = [*((c, c, "characteristics") for c in R.CHARACTERISTICS), *((c, c, "macros") for c in R.MACROS), *((f"sic2_{k}", f"CASE WHEN sic2 = {k} THEN 1.0 ELSE 0.0 END", "dummies") for k in CODES)]
    return O._q(" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS feature, '{r}' AS role, {O._r(f'avg({x})', 'mean')} FROM panel" for i, (c, x, r) in enumerate(listed)))


_SUM = "(" + " + ".join(R.CHARACTERISTICS) + ")"
_INDUSTRIES = "(SELECT count(DISTINCT sic2) FROM panel)"
_BEST = "curve AS (SELECT grid_index, alpha, " + O._R2.format("fc") + " AS r2 FROM f GROUP BY 1, 2), best AS (SELECT alpha FROM curve ORDER BY r2 DESC, grid_index LIMIT 1)"

ORACLES: dict[str, str] = {
    "raw_tables_read_back": O.ORACLES["panel_build"],
    "bucketed_panel_build": O.ORACLES["panel_build"],
    "panel_read_back": O.ORACLES["panel_build"],
    "results_read_back": O._q(f"SELECT b.*, n_predictions FROM ({O._q('SELECT model, max(n) FILTER (split = $$test$$) AS test_rows, max(r2) FILTER (split = $$test$$) AS test_oos_r2, max(r2) FILTER (split = $$validation$$) AS validation_oos_r2 FROM b GROUP BY 1', f'b AS (SELECT model, split, count(*) AS n, {O._r(O._R2.format("forecast"), "r2")} FROM forecasts GROUP BY 1, 2)')}) b JOIN (SELECT model, count(*) AS n_predictions FROM forecasts GROUP BY 1) USING (model)"),
    "family_results_read_back": O._q(f"SELECT model, bucket, {O._r('avg(portfolio_return)', 'mean_return')}, {O._r(O._SHARPE.format('portfolio_return', 12), 'sharpe')}, {O._r('any_value(mse_raw)', 'mse_raw')} FROM mreturns JOIN merror USING (model) GROUP BY 1, 2", _test_portfolios()),
    "evaluation_spread": O._q(f"SELECT model, {O._r('avg(long_short)', 'mean_spread')}, {O._r(O._SHARPE.format('long_short', 12), 'sharpe')} FROM mspread GROUP BY 1", _test_portfolios()),
    "reports_read_back": O.ORACLES["sample_summary"],
    "manifest_read_back": O._q(f"SELECT (SELECT count(*) FROM panel) AS rows, count(DISTINCT feature) AS interaction_features, count(*) AS interaction_nonzero, '{','.join(R.CHARACTERISTICS)}' AS characteristics, '{','.join(R.MACROS)}' AS macros, '{','.join(DUMMIES)}' AS dummies FROM ({O._INDUSTRY}) WHERE value <> 0"),
    "interactions_read_back": O.ORACLES["interaction_vector"],
    "feature_order": _order_sql(),
    "ridge_choice": O._q(f"SELECT permno, month, split, {O._r('my + (n * c / sd) / (n + alpha) * (disc - m) / sd', 'forecast')} FROM split, s, best WHERE split <> 'train'", f"{O._RIDGE_GRID}, {_BEST}"),
    "dense_sparse_vector": O._q(f"SELECT permno, month, CAST({len(R.CHARACTERISTICS)} * (1 + {_INDUSTRIES}) AS INTEGER) AS n_features, {O._r(f'2 * {_SUM}', 'total')} FROM panel"),
    "built_features": O._q(f"SELECT permno, month, CAST({len(R.CHARACTERISTICS)} * (1 + {len(R.MACROS)} + {_INDUSTRIES}) + {len(CODES)} AS INTEGER) AS n_features, {O._r(f'{_SUM} * (2 + ' + ' + '.join(R.MACROS) + ') + 1', 'total')} FROM panel"),
    "estimator_adapter": O.ORACLES["ols_forecast_2f"],
    "custom_function": O.ORACLES["ridge_forecast_2f"],
    "rescored_importance": O.ORACLES["drop_importance_linear"],
}
_REPORT_SQL = {
    "sample_summary": O.ORACLES["sample_summary"], "model_r2": O.ORACLES["model_metrics"], "model_dm_tests": O.ORACLES["dm_matrix"], "decile_portfolios": O.ORACLES["decile_performance"],
    "long_short_performance": ORACLES["evaluation_spread"], "variable_importance": O.ORACLES["drop_importance_linear"],
}
ORACLES |= {
    "estimator_on_vectors": O.ORACLES["ols_forecast_2f"],
    "pipeline_saved_forecast": O.ORACLES["ols_forecast_2f"],
    "all_reports_read_back": " UNION ALL ".join(f"(SELECT '{n}' AS report, count(*) AS n_rows, {O._r(f'sum({m})', 'total')} FROM ({_REPORT_SQL[n]}))" for n, m in _REPORT_MEASURES.items()),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in ORACLES}
