import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares a Spark DataFrame with a DuckDB relation, without order."""

    def norm(df):
        def one(x):
            if x is None or x != x:
                return None
            if isinstance(x, bool) or type(x).__name__ == "bool_":
                return bool(x)
            kind = type(x).__name__
            if kind.startswith("int") or kind == "int":
                return int(x)
            if kind.startswith("float") or kind == "Decimal":
                return round(float(x), 6)
            return str(x).replace(" 00:00:00", "")

        df = df[sorted(df.columns)]
        return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)

    def check(spark_df, relation):
        a, b = spark_df.toPandas(), relation.df()
        assert sorted(a.columns) == sorted(b.columns)
        assert norm(a) == norm(b)

    return check
