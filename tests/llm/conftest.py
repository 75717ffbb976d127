import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) or longer rows, with extra columns whose names clash."""

    def make(rows, **extra):
        full = [tuple(r) + (None, None, None)[len(r) - 2 :] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        for name in ("fp", "n", "key", "part", "a", "b", "root", "line", "place", "size", "score", "tokens", "gone", "stay", "held_by", "taken", "h", "site", "of", "kind", "run", "member", "quality", "stratum", "n_lines"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
