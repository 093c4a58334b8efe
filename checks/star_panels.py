"""Panels computed from the star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from checks.shape import steady_round
from panelloom.packs import campaigns, inventory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(ts: Column) -> Column:
    """First day of the month: cheap to group by, formatted after the aggregate."""
    return F.trunc(ts.cast("date"), "MM")


def period_text(first_day: str) -> Column:
    return F.date_format(first_day, "yyyy-MM")


def with_supplier(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """Attach name, nation and region. Equi-joins; AQE picks the strategy by size."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return cells.join(places, F.col("l_suppkey") == F.col("s_suppkey"))


def inventory_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x month as a stock report: products are suppliers."""
    qty, ext = F.col("l_quantity"), F.col("l_extendedprice")
    flag, unit = F.col("l_returnflag"), F.col("l_extendedprice") / F.col("l_quantity")
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", month(F.col("l_shipdate")).alias("month"))
        .agg(
            F.sum(F.when(flag.isin("A", "N"), qty).otherwise(0.0)).alias("giris_miktar"),
            F.sum(F.when(flag.isin("R", "N"), qty).otherwise(0.0)).alias("cikis_miktar"),
            steady_round(F.avg(unit * (0.55 + 4 * F.col("l_discount"))), 4).alias("birim_maliyet_tl"),
            steady_round(F.avg(ext / qty), 4).alias("birim_satis_tl"),
        )
    )
    panel = with_supplier(spark, sf_dir, cells).select(
        F.col("l_suppkey").cast("string").alias("stok_kodu"),
        F.col("s_name").alias("urun_adi"),
        F.col("n_name").alias("kategori"),
        F.col("r_name").alias("depo"),
        period_text("month").alias("donem"),
        "giris_miktar",
        "cikis_miktar",
        "birim_maliyet_tl",
        "birim_satis_tl",
    )
    history = inventory.PACK.panel.history
    running = F.sum(F.col("giris_miktar") - F.col("cikis_miktar")).over(
        history.rowsBetween(Window.unboundedPreceding, 0)
    )
    stock = F.greatest(F.lit(0.0), 300 + running)
    return panel.withColumn("donem_sonu_stok", stock)


def campaign_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x month as a campaign report: campaigns are suppliers."""
    qty, ext = F.col("l_quantity"), F.col("l_extendedprice")
    ship = F.col("l_shipdate")
    revenue = F.when(F.col("l_returnflag") == "A", 4 * ext * F.col("l_tax")).otherwise(0.0)
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", month(ship).alias("month"))
        .agg(
            F.round(F.sum(ext * F.col("l_discount")), 4).alias("harcama_tl"),
            F.round(F.sum(revenue), 4).alias("gelir_tl"),
            F.sum(qty).alias("tiklama"),
            F.count_if(F.col("l_linestatus") == "F").cast("double").alias("donusum"),
            steady_round(1 + F.avg(qty) / 20, 4).alias("frekans"),
        )
    )
    reach = 0.5 + ((7 * F.col("l_suppkey") + F.month("month")) % 11) / 10.0
    return with_supplier(spark, sf_dir, cells).select(
        F.col("l_suppkey").cast("string").alias("kampanya_id"),
        F.col("s_name").alias("kampanya_adi"),
        F.col("r_name").alias("platform"),
        F.col("n_name").alias("urun_kategorisi"),
        period_text("month").alias("donem"),
        "harcama_tl",
        F.round(30 * F.col("tiklama") * reach, 2).alias("gosterim"),
        "tiklama",
        "frekans",
        "donusum",
        "gelir_tl",
    )


PANELS = {inventory.PACK.key: inventory_panel, campaigns.PACK.key: campaign_panel}
