import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="spark-", dir="/tmp", ignore_cleanup_errors=True) as shared:
        session = (
            SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows_of(df):
    """Rows as sorted tuples, columns by name, numbers rounded: what a comparison of two engines needs."""
    names = sorted(df.columns)

    def plain(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat().replace("T00:00:00", "").replace(" 00:00:00", "")
        try:
            return format(round(float(v), 6) + 0.0, ".6g") if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    frame = df if not hasattr(df, "toPandas") else None
    data = [tuple(r[n] for n in names) for r in df.collect()] if frame is None else [tuple(r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)]
    return names, sorted(tuple(plain(v) for v in r) for r in data)
