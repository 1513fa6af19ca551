import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioscope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column function over rows of arguments."""

    def run(fn, rows, schema="text string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        names = [c for c in df.columns if c != "_i"]
        out = df.select("_i", fn(*[df[c] for c in names]).alias("out")).collect()
        return [r["out"] for r in sorted(out, key=lambda r: r["_i"])]

    return run
