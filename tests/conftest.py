import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("the test tables are not here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(df, cursor):
    """Rows and columns of a DataFrame and a DuckDB result agree, floats to 9 digits."""

    def norm(value):
        if isinstance(value, float):
            return None if value != value else float(f"{value:.9g}")
        return value if value is None or isinstance(value, (bool, int, str)) else str(value)

    names = sorted(df.columns)
    found = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    have = [d[0] for d in cursor.description]
    wanted = sorted((tuple(norm(r[have.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert names == sorted(have)
    assert found == wanted
