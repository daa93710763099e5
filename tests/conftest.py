import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry

    folder = tempfile.mkdtemp()
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/shared").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    entry._ship(session)
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def compare(spark, name, query, sql, sf_dir):
    """Rows of a query and of its SQL, as sorted lists with columns in name order."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), name
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    order = sorted(names)
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in got.fetchall()), key=repr)
    assert ours == theirs, name
    return len(ours)
