"""Panel tables made from the order tables: suppliers are the assets, shipping months the dates.

Derived numbers are rounded to eight places here, so that ties are ties in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.functions.nulls import divide
from panelkiln.sources.schema import MACROS


def _r(column: Column) -> Column:
    return F.round(column, 8)


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five raw tables of a panel."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    month = F.last_day(F.to_date("l_shipdate"))
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    grouped = read("lineitem").groupBy(F.col("l_suppkey").alias("permno"), month.alias("month")).agg(
        _r(F.sum(price * (1 - discount))).alias("me"), F.count("*").cast("double").alias("n_lines"), _r(F.avg(discount)).alias("disc"), _r(F.avg("l_quantity")).alias("qty"),
        _r(F.avg("l_tax")).alias("tax"), _r(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("retrate"), _r(F.stddev_samp(price)).alias("disp"),
    )
    yyyymm = (F.year("month") * 100 + F.month("month")).cast("int").alias("yyyymm")
    before = F.lag("me").over(Window.partitionBy("permno").orderBy("month"))
    returns = grouped.select("permno", "month", "me", _r(divide(F.col("me"), before) - 1).alias("ret"))
    characteristics = grouped.select("permno", yyyymm, "n_lines", "disc", "qty", "tax", "retrate", "disp")
    industry = grouped.select("permno", "month").join(read("supplier").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").cast("int").alias("sic2")), "permno")

    total, urgent = F.col("o_totalprice"), F.col("o_orderpriority")
    orders = read("orders").withColumn("month", F.last_day(F.to_date("o_orderdate")))

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    monthly = [
        F.avg(total) / 1e6, share(urgent == "1-URGENT"), share(urgent == "2-HIGH"), share(urgent == "3-MEDIUM"),
        share(urgent == "5-LOW") / 10, share(total > 200000.0), F.min(total) / 1e5, F.stddev_samp(total) / 1e6,
    ]
    macro = orders.groupBy("month").agg(*(_r(x).alias(c) for c, x in zip(MACROS, monthly, strict=True)), _r(share(F.col("o_orderstatus") == "F") / 100).alias("rf_welch_goyal")).select(yyyymm, *MACROS, "rf_welch_goyal")
    by_priority = {"mktrf": "1-URGENT", "smb": "2-HIGH", "hml": "3-MEDIUM", "rmw": "4-NOT SPECIFIED", "cma": "5-LOW"}
    factors = orders.groupBy("month").agg(
        _r(share(F.col("o_orderstatus") == "O") / 100).alias("rf"), *(_r(share(urgent == p) - 0.2).alias(c) for c, p in by_priority.items()), _r(F.max(total) / 1e6).alias("umd"),
    ).select(yyyymm, "rf", *by_priority, "umd")
    return {"stock_returns": returns, "stock_characteristics": characteristics, "industry_dummies": industry, "welch_goyal_macros": macro, "fama_french_factors": factors}
