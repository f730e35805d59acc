"""Reading and writing panels, predictions, manifests and reports."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelkiln.functions.nulls import nan_to_null
from panelkiln.functions.ranks import rank_minmax_scaled
from panelkiln.sources.schema import choose_columns, named, roles, validate

RAW_TABLES = ("stock_returns", "stock_characteristics", "industry_dummies", "welch_goyal_macros", "fama_french_factors")
REPORTS = ("sample_summary", "model_r2", "model_dm_tests", "decile_portfolios", "long_short_performance", "variable_importance")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    folder = given.get() if given.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{folder}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a new shared folder and read back, for work that reads them several times."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_raw(spark: SparkSession, folder: str, schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """The five raw tables, NaN turned into NULL. Scans stay lazy, so each use reads its own columns.

    A table with a given schema is read with it; columns that its files lack are then NULL.
    """
    def read(name: str) -> DataFrame:
        reader = spark.read.schema(schemas[name]) if schemas and name in schemas else spark.read
        return nan_to_null(reader.parquet(f"{folder}/{name}.parquet"))

    return {name: read(name) for name in RAW_TABLES}


def write_bucketed(raw: dict[str, DataFrame], prefix: str, folder: str, buckets: int = 200, asset: str = "permno") -> None:
    """The raw tables as catalog tables `prefix`_name whose files lie in `folder`.

    Tables with an asset are dealt to buckets by it and sorted by asset and time, once. Choose buckets of some hundred MB; all
    tables must have the same number.
    """
    for name, df in raw.items():
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}")
        if asset in df.columns:
            time = "month" if "month" in df.columns else "yyyymm"
            writer = df.repartition(buckets, asset).write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}").bucketBy(buckets, asset).sortBy(asset, time)
        writer.saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The tables of `write_bucketed`. Leads and joins by asset and month of these need no exchange.

    Sets spark.sql.requireAllClusterKeysForCoPartition to false in the session: by default Spark deals the tables of a join
    anew unless they are dealt by all of its keys, although rows of one asset lie together already.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return {name: nan_to_null(spark.table(f"{prefix}_{name}")) for name in RAW_TABLES}


def load_panel(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A stored panel, checked. Its order is left open: whatever needs one orders its windows."""
    date = named(names)["date"]
    return validate(nan_to_null(spark.read.parquet(path)), names).withColumn(date, F.to_date(date))


def write_panel(panel: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Parquet by year, sorted within files, so that date filters prune folders and row groups."""
    own = named(names)
    panel.withColumn("year", F.year(own["date"])).repartition("year").sortWithinPartitions(own["date"], own["asset"]).write.mode("overwrite").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(predictions: DataFrame, metrics: DataFrame, folder: str) -> None:
    predictions.write.mode("overwrite").parquet(f"{folder}/predictions")
    write_csv(metrics, f"{folder}/metrics")


def write_family_results(name: str, metrics: DataFrame, deciles: DataFrame, predictions: DataFrame, folder: str) -> None:
    """Metrics as JSON, the decile table as CSV, predictions as Parquet."""
    metrics.write.mode("overwrite").json(f"{folder}/{name}_metrics")
    write_csv(deciles, f"{folder}/{name}_deciles")
    predictions.write.mode("overwrite").parquet(f"{folder}/{name}_predictions")


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """Each known report as a folder of CSV."""
    unknown = sorted(set(tables) - set(REPORTS))
    if unknown:
        raise ValueError(f"unknown reports: {', '.join(unknown)}")
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def manifest(panel: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, columns, the features of each role and the special columns."""
    own, special = roles(panel, names), named(names)
    lists = [F.array(*map(F.lit, own[k])).cast("array<string>").alias(k) for k in ("characteristics", "dummies", "macros")]
    columns = [F.lit(special[k]).alias(f"{k}_column") for k in ("target", "date", "asset", "weight")]
    return panel.agg(F.count("*").alias("rows")).select("rows", F.lit(len(panel.columns)).cast("long").alias("columns"), *lists, *columns)


def write_manifest(panel: DataFrame, path: str, names: dict[str, str] | None = None, interactions: DataFrame | None = None) -> None:
    """The manifest as JSON; of long interactions (feature, value) also their shape and number of values that are not 0."""
    row = manifest(panel, names)
    if interactions is not None:
        row = row.crossJoin(interactions.agg(F.countDistinct("feature").alias("interaction_features"), F.sum((F.col("value") != 0).cast("long")).alias("interaction_nonzero")))
    row.write.mode("overwrite").json(path)


def write_interactions(block: DataFrame, path: str, keys: tuple[str, ...] = ("permno", "month"), vector: str = "interactions") -> None:
    """Keys and a sparse vector column as Parquet; its feature names stay in the column's metadata."""
    block.select(*keys, vector).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str, panel: DataFrame) -> dict[str, list[str]]:
    """The roles of a stored manifest, cut to the columns that the panel has. Dummies may be called industry_dummies."""
    row = json.loads(spark.read.option("multiLine", True).json(path).toJSON().first())
    row.setdefault("dummies", row.get("industry_dummies", []))
    return {k: [c for c in row.get(k, []) if c in panel.columns] for k in ("characteristics", "dummies", "macros")}


def out_of_rank_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: is any value of the columns below -1 or above 1?"""
    spans = [F.coalesce(F.min(c) < -1, F.lit(False)) | F.coalesce(F.max(c) > 1, F.lit(False)) for c in columns]
    anywhere = spans[0]
    for s in spans[1:]:
        anywhere = anywhere | s
    return df.agg(anywhere.alias("raw_values"))


def ranked(df: DataFrame, by: str = "yyyymm", columns: list[str] | None = None) -> DataFrame:
    """The table with the chosen columns as ranks from -1 to 1 inside each period."""
    chosen = choose_columns(df, columns)
    return df.select(*(rank_minmax_scaled(c, by).alias(c) if c in chosen else F.col(c) for c in df.columns))


def ranked_copy(spark: SparkSession, source: str, target: str, by: str = "yyyymm", columns: list[str] | None = None, force: bool = False) -> None:
    """A ranked copy of a stored table; refuses to overwrite its source, and data that look ranked unless forced."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("source and target are the same")
    df = nan_to_null(spark.read.parquet(source))
    chosen = choose_columns(df, columns)
    if chosen and not force and not out_of_rank_range(df, chosen).head()[0]:
        raise ValueError("the values look ranked already")
    ranked(df, by, chosen).write.mode("overwrite").parquet(target)
