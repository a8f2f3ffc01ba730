"""Audit the executed plans of the registered queries: corpus scans, shuffles, Python nodes.

    python -m cotopic.plans.audit /root/testdata/sf0.01

The corpora are written once as Parquet so their scans can be told apart from scans of the
driver tables; every query is run (``noop`` writer) and its final adaptive plan inspected.
"""

from __future__ import annotations

import re
import sys

from cotopic.plans.catalogue import QUERIES, Corpus
from cotopic.session import local_session, scratch_path
from cotopic.sources.fixtures import star_news, text_news
from cotopic.sources.news import materialize

SHUFFLE = re.compile(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)")
PYTHON = re.compile(r"EvalPython|InPandas|PythonUDF")


def audit(sf_dir: str) -> list[tuple[str, int, int, bool]]:
    spark = local_session(8, 8, app="cotopic-audit")
    corpus = Corpus(spark, sf_dir,
                    star=materialize(star_news(spark, sf_dir), scratch_path(spark, "audit-star")),
                    text=materialize(text_news(spark, sf_dir), scratch_path(spark, "audit-text")))
    out = []
    for name in sorted(QUERIES):
        df = QUERIES[name](corpus)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line
                 and any(c in line for c in ("keywords", "archive:string", "timestamp:int"))]
        out.append((name, len(scans), len(SHUFFLE.findall(plan)), bool(PYTHON.search(plan))))
    return out


if __name__ == "__main__":
    for name, scans, shuffles, python in audit(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"):
        print(f"{name:28s} corpus_scans={scans} shuffles={shuffles} python={python}")
