import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """Writes small tables into a folder laid out like a scale-factor folder."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
