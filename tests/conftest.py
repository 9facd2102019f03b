import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codegauge.session import get_session
    s = get_session("local[4]", 4, app_name="codegauge-tests")
    yield s


def lines_df(spark, files):
    """files: {file_id: (lang, content)} -> lines table (file_id, lang, pos, line)."""
    from codegauge.sources.files import file_lines
    rows = [(k, lang, text) for k, (lang, text) in files.items()]
    df = spark.createDataFrame(rows, "file_id LONG, lang STRING, content STRING")
    return file_lines(df, ["file_id"])
