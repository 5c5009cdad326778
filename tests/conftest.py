import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="cellgrid-tests-") as folder:
        session = (
            SparkSession.builder.master("local[4]")
            .config("spark.sql.shuffle.partitions", "4")
            .config("spark.driver.memory", "4g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
            .config("spark.checkpoint.dir", f"{folder}/shared")
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def database(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def values(rows, columns):
    """Rows as a sorted list of text tuples, columns in the order of their names."""
    return sorted(tuple(str(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, database):
    def check(query, sql):
        got = query(spark, sf_dir)
        want = database.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert values([r.asDict() for r in got.collect()], got.columns) == values([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)

    return check
