import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from votelake.session import build_session

    SparkSession.builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    s = build_session("local[4]", "tests", partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
