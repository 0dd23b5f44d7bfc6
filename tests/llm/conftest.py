import pytest
from pyspark.sql import types as T

ASSETS = "asset_id long, text string, batch_id string, batch int, shard string"


@pytest.fixture
def assets(spark):
    """Assets from (asset_id, text) rows, with columns whose names clash with internal ones."""

    def make(rows, partitions=3):
        rows = [(i, t, f"b{n % 3}", n, "x") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, T._parse_datatype_string(ASSETS)).repartition(partitions)

    return make
