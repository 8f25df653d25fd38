import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from doclens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        4, 4, spark__ui__showConsoleProgress="false", spark__checkpoint__dir=root
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression on a list of texts."""

    def run(expression, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", expression.alias("v"))
        return [r["v"] for r in rows.orderBy("i").collect()]

    return run
