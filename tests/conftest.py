import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.adaptive.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{root}/checkpoint")
        .config("spark.sql.warehouse.dir", f"file://{root}/warehouse")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def library(spark):
    """The libraries' database, its relations held in memory."""
    from library import lines

    from weft.catalog import BINARY, UNARY
    from weft.sources.facts import load_lines

    db = load_lines(spark, lines())
    for key, rel in db.relations.items():
        db.relations[key] = spark.createDataFrame([tuple(r) for r in rel.collect()], BINARY if key[1] == 2 else UNARY).coalesce(1)
    return db
