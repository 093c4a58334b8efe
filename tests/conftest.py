import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HEADER = (
    "stok_kodu,urun_adi,kategori,depo,donem,giris_miktar,cikis_miktar,donem_sonu_stok,"
    "birim_maliyet_tl,birim_satis_tl"
)


@pytest.fixture
def write_csv(tmp_path):
    def write(*lines, header=HEADER, name="report.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes("\n".join((header, *lines)).encode(encoding) + b"\n")
        return str(path)

    return write


def by_code(outcome):
    return {r["code"]: r for r in outcome.issues.collect()}
