import pytest
from pyspark.sql import functions as F

from panelloom.functions.numbers import read_numbers
from panelloom.functions.text import fixed_sql, fold_name, render, strip

SPELLINGS = {
    "12500": 12500.0,
    "12.5": 12.5,
    "12,5": 12.5,
    "12.500": 12500.0,
    "12,500": 12500.0,
    "1.234,56": 1234.56,
    "1,234.56": 1234.56,
    "1 200": 1200.0,
    "1 200": 1200.0,
    "-12.500": -12500.0,
    "1.234.567": 1234567.0,
    "-0,25": -0.25,
    "12.34.56": None,
    "abc": None,
    "1e3": None,
    "12d": None,
    "NaN": None,
    "": None,
    ".5": None,
}


def test_number_spellings(spark):
    rows = spark.createDataFrame([(k,) for k in SPELLINGS], "t string")
    read = read_numbers(rows.withColumn("v", F.col("t")), {"v": "double"})
    read = {r["t"]: r["v"] for r in read.collect()}
    assert read == SPELLINGS


def test_integer_cast(spark):
    rows = spark.createDataFrame([("1.234,56",), ("x",)], "t string")
    assert [r[0] for r in read_numbers(rows, {"t": "bigint"}).collect()] == [1234, None]


def test_strip_and_fold(spark):
    rows = spark.createDataFrame([("\t  Döşemelik İŞ ",)], "t string")
    row = rows.select(strip(F.col("t")).alias("s"), fold_name(F.col("t")).alias("f")).first()
    assert row["s"] == "Döşemelik İŞ"
    assert row["f"] == "dosemelik is"


@pytest.mark.parametrize(
    ("value", "decimals", "shown"),
    [(0.25, 1, "0.2"), (0.35, 1, "0.3"), (2.5, 0, "2"), (1234567.891, 2, "1 234 567.89")],
)
def test_half_even_formatting(spark, value, decimals, shown):
    # the expected texts are what Python's format gives
    assert f"{value:,.{decimals}f}".replace(",", " ") == shown
    row = spark.createDataFrame([(value,)], "x double").selectExpr(
        f"{fixed_sql('x', decimals, ' ')} AS s"
    )
    assert row.first()["s"] == shown


def test_template(spark):
    rows = spark.createDataFrame([(12345.6, None, "2026-01", "it's")], "a double, b double, p string, q string")
    text = rows.select(render("%{a:.0f} / {a:tl} / {b:.1f} / {b:d} / {p} 'x' {q}").alias("t")).first()
    assert text["t"] == "%12346 / 12.346 TL / 0.0 / 0 / 2026-01 'x' it's"
