import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents with columns whose names clash with results."""
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, a hard blank."""
    long = " ".join(f"wort{i % 977} Ünïcode{i % 31}" for i in range(30_000))
    rows = rows_of(["", None, "eins zwei drei vier fünf", "a\x0bb\x1cc d e ß", long, "Kurz."])
    rows += [rows[2], rows[2], (None, "ohne Nummer", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"
