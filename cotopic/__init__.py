"""cotopic: topic co-occurrence analytics over an article archive, on Spark DataFrames."""

from cotopic.operators import *  # noqa: F401,F403
from cotopic.schema import NEWS  # noqa: F401
