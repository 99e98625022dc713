import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: The data set of the reference's own tests, row for row, as FIXTURES.md lists it. Label, source and target with tabs
#: between; tokens are numbers.
HE_TINY = """1\t0 1 2\t3 4 5
1\t6 1 7 6 8 9\t3 4 10 11 12 13
1\t6 14 15 0 16 6 7\t3 17 18 19 10
1\t20 21\t3 22
1\t20 21 14 6 7\t3 22 17 10
1\t20 21 23 6 7 21\t3 22 24 3 10 22
1\t20 21 23 25\t3 22 24 24 18
1\t20 21 26 6 7 21\t3 22 24 24 10 22
1\t20 21 8 27 2 21\t3 22 12 24 28 22
1\t20 21 7 20 21\t3 22 10 22
0\t33 6 46 46\t34 24 13 30 24
0\t48 6 14 21 20 27\t4 11 10 30
0\t25 20 35 15 21 6 35\t17 10 18 28 4 10 17
0\t48 0 8 8 25\t43 10 12 5
0\t14 35 0 49 6\t41 34 19 24 4 13 34 18
0\t21 0 2\t30 24 19 28 22
0\t6 35 0 8 6 6 36\t22 24 12 37 18 19
0\t6 16 20 42 20 25\t17 10 18 18
0\t31 0 2 33 0 20 16 33 7 6 15 29\t22 24 11 3 10 30 18
0\t6 7 29 15 7\t4 18 24"""


@pytest.fixture(scope="session")
def he_tiny():
    """(source, target, y) of the 20 examples."""
    rows = [line.split("\t") for line in HE_TINY.split("\n")]
    return [(s.split(), t.split(), int(y)) for y, s, t in rows]


@pytest.fixture(scope="session")
def he_tiny_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "he_tiny"
    path.write_text(HE_TINY + "\n")
    return str(path)
