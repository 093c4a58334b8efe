import pytest


@pytest.fixture
def documents(spark):
    def made(*rows, schema="doc_id long, text string, source string"):
        return spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows], schema)

    return made
