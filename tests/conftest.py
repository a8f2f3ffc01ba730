import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cotopic.schema import NEWS  # noqa: E402
from cotopic.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def U(d, rest):
    return f"https://archive.example/noFrame/replay/{d}000000/{rest}"


# The hand-made corpus with worked answers (topic "q").
HAND_ROWS = [
    (201501, "alpha", U("20150105", "https://www.alpha.example/2015-01-05-big-story_1?x=1"), 1, 1.0, {"q": 5, "a": 5, "b": 1}, 0.5),
    (201501, "beta", U("20150110", "http://www.alpha.example/Big-Story/"), 2, 1.0, {"q": 6, "a": 1, "c": 7}, -0.5),
    (201503, "alpha", U("20150301", "https://beta.example/12345?ref=a"), 3, 1.0, {"q": 9}, 0.25),
    (201504, "alpha", U("20150402", "https://www.alpha.example/other-tale"), 4, 1.0, {"q": 5, "b": 4}, -1.0),
    (201502, "beta", U("20150203", "https://beta.example/never-hit"), 5, 1.0, {"q": 4, "a": 50}, 1.0),
    (201505, None, "https://beta.example/x", 6, 1.0, {"a": 3}, 0.75),
    (201504, None, None, 7, 1.0, {"q": 5, "c": 1, "d": 4}, None),
]


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="cotopic-tests")
    yield s


@pytest.fixture(scope="session")
def hand(spark):
    return spark.createDataFrame(HAND_ROWS, NEWS)
