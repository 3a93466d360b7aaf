import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


POSTING = "source_id string, title string, company string, url string, location string, description string, ord long"


@pytest.fixture
def postings(spark):
    def make(*rows):
        full = [{"source_id": "test", "title": "Test Engineer", "company": "Test GmbH", "url": f"https://example.test/{i}", "location": "", "description": "", "ord": i} | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[k] for k in ("source_id", "title", "company", "url", "location", "description", "ord")) for r in full], POSTING)

    return make
