import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session
    s = get_session("local[4]", 4)
    yield s


@pytest.fixture
def lines_of(spark):
    """code_lines DataFrame from {path: text}; language from the extension."""
    from vigil.functions.paths import detect_language
    from vigil.operators.lines import explode_lines
    from pyspark.sql import functions as F

    def make(files: dict):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        return explode_lines(df.select("path", detect_language(F.col("path")).alias("language"), "content"))
    return make
