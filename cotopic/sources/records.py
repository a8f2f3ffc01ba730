"""The whole record of chosen topics, kept up to date with a growing corpus.

For every stored topic and related keyword the store holds mergeable states (``operators.topics.state_rows``): mentions, tone sums, articles
and archive extremes, once per (topic, keyword) and once per month and outlet; and, for every article, its row and its postings
(``sources.layout``). All reports of a search - relation set, months, outlets, histories, years, article lists - are made from these
without reading the corpus, and sum the states of as many batches as there are.

Parts and commits. A table's rows lie in parts, ``<root>/<table>/batch=<id>``. A commit is one small file,
``<root>/commits/<number>.json``, that names the parts it adds and removes, table by table; it is renamed into place after all its parts are written. Readers
open exactly the parts that the commits name, so they see a batch in every table or in none, and what a failed batch left behind is never
read. Numbers are taken once: of two writers that start from one state the second gets ``Conflict`` and plans anew.

Growth. Every stored topic covers every stored file. New files make a batch of these files for all stored topics, new topics a batch of
all stored articles for these topics (read from the store's own articles). Files are compared by path, length and time of
change; if a stored one has changed or gone, its articles cannot be taken out of the sums, and everything is computed anew in one commit.

At scale: a new month reads that month's files only. States are partial sums before every shuffle; a keyword of a third of all articles is
one row per task. Parts are cut by range of (topic, keyword), so a hot topic spans many files, and a lookup skips the row
groups of other topics. The driver holds names of new files and of parts, and the commits (``compact`` folds the parts of many batches).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.operators.topics import EXTREMES, STATES, merge_states, state_rows, topic_hits
from cotopic.operators.relations import relations
from cotopic.schema import MIN_COUNT, MIN_MENTIONS
from cotopic.sources.layout import ARTICLES_DDL, POSTINGS_DDL, POSTINGS_FORMAT, hits_by_key, keyed_articles, sorted_postings
from cotopic.sources.news import read_news

_SUMS = "n long, tone_sum double, tone_n long, articles long, archived long, first_archive string, last_archive string"
TABLES = {
    "inputs": "path string, length long, changed timestamp",
    "articles": ARTICLES_DDL,
    "postings": POSTINGS_DDL,
    "topics": "topic string",
    "cells": f"topic string, keyword string, timestamp int, source string, {_SUMS}",
    "totals": f"topic string, keyword string, {_SUMS}",
}


class Conflict(RuntimeError):
    """Another writer committed first."""


class RecordStore:
    def __init__(self, spark: SparkSession, root: str, min_mentions: int = MIN_MENTIONS):
        self.spark, self.root, self.min_mentions = spark, root.rstrip("/"), min_mentions
        self._known: dict[str, dict] = {}

    # commits

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(conf), path

    def live(self) -> tuple[int, dict[str, list[str]]]:
        """The number of commits, and the batches of every table's parts."""
        fs, path = self._fs()
        folder = path(f"{self.root}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
        parts: dict[str, list[str]] = {t: [] for t in TABLES}
        for n in names:
            if n not in self._known:  # a commit never changes
                stream = fs.open(path(folder, n))
                self._known[n] = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
                stream.close()
            commit = self._known[n]
            if commit["min_mentions"] != self.min_mentions:
                raise ValueError(f"the store holds hits of more than {commit['min_mentions']} mentions, asked for {self.min_mentions}")
            for t, gone in commit["removes"].items():
                parts[t] = [b for b in parts[t] if b not in set(gone)]
            for t, batch in commit["adds"].items():
                parts[t].append(batch)
        return len(names), parts

    def _commit(self, version: int, adds: dict[str, str], removes: dict[str, list[str]]) -> None:
        """Make parts visible at once, on top of ``version`` commits."""
        fs, path = self._fs()
        text = json.dumps({"min_mentions": self.min_mentions, "adds": adds, "removes": removes})
        made = path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        place = path(f"{self.root}/commits/{version:010d}.json")
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(place) or not fs.rename(made, place):
            fs.delete(made, False)
            raise Conflict(f"commit {version} was taken by another writer")

    def _write(self, df: DataFrame, table: str, batch: str) -> None:
        options = POSTINGS_FORMAT if table == "postings" else {"compression": "zstd"}
        df.write.options(**options).parquet(f"{self.root}/{table}/batch={batch}")

    def read(self, table: str, batches: list[str] | None = None) -> DataFrame:
        """The committed rows of a table, with their ``batch``."""
        batches = self.live()[1][table] if batches is None else batches
        schema = f"{TABLES[table]}, batch string"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
                .parquet(*[f"{self.root}/{table}/batch={b}" for b in batches]))

    # growth

    def _states(self, articles: DataFrame, topics: DataFrame, batch: str) -> None:
        """Write the cells and totals of ``topics`` in ``articles``."""
        hits = topic_hits(articles, topics, self.min_mentions)
        cells = merge_states(state_rows(hits, "timestamp", "source"), "timestamp", "source")
        self._store_states(cells, batch)

    def _store_states(self, cells: DataFrame, batch: str) -> None:
        keys = ["topic", "keyword", "timestamp", "source"]
        self._write(cells.select(*keys, *STATES, *EXTREMES).repartitionByRange(*keys).sortWithinPartitions(*keys), "cells", batch)
        totals = merge_states(self.read("cells", [batch]))
        self._write(totals.repartitionByRange("topic", "keyword").sortWithinPartitions("topic", "keyword"), "totals", batch)

    def add_articles(self, news: DataFrame, inputs: DataFrame | None = None, replace: bool = False) -> None:
        """One batch of new articles for all stored topics; ``inputs`` (``path, length, changed``) names the files they come from. With
        ``replace`` the batch takes the place of everything stored but the topics."""
        version, parts = self.live()
        batch = uuid.uuid4().hex
        self._write(keyed_articles(news), "articles", batch)
        articles = self.read("articles", [batch]).drop("batch")
        self._write(sorted_postings(articles), "postings", batch)
        adds = {"articles": batch, "postings": batch}
        if inputs is not None:
            self._write(inputs.select("path", "length", "changed"), "inputs", batch)
            adds["inputs"] = batch
        if parts["topics"]:
            self._states(articles.drop("key"), self.read("topics", parts["topics"]).select("topic"), batch)
            adds |= {"cells": batch, "totals": batch}
        self._commit(version, adds, {t: b for t, b in parts.items() if b and t != "topics"} if replace else {})

    def add_topics(self, topics: Iterable[str] | DataFrame) -> None:
        """Those of ``topics`` that are not stored yet, in all stored articles; a topic without hits is stored, too."""
        version, parts = self.live()
        if not isinstance(topics, DataFrame):
            topics = self.spark.createDataFrame([(t,) for t in sorted({topics} if isinstance(topics, str) else set(topics))], "topic string")
        known = self.read("topics", parts["topics"]).select("topic")
        batch = uuid.uuid4().hex
        self._write(topics.select("topic").where("topic IS NOT NULL").distinct().join(known, "topic", "left_anti"), "topics", batch)
        new = self.read("topics", [batch]).select("topic")
        if new.isEmpty():
            return
        self._states(self.read("articles", parts["articles"]).drop("batch", "key"), new, batch)
        self._commit(version, {"topics": batch, "cells": batch, "totals": batch}, {})

    def refresh(self, path: str, fmt: str = "json", status: str | None = "success", topics: Iterable[str] | DataFrame | None = None,
                read: Callable[[list[str]], DataFrame] | None = None) -> int:
        """Bring the store up to the files below ``path``, then add ``topics``. Returns how many files were read.

        Only files not stored yet are read (by ``read``, given their paths; by default ``read_news``). Listing reads no file.
        """
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select("path", "length", F.col("modificationTime").alias("changed")))
        stored = self.read("inputs").select("path", "length", "changed")
        same = ["path", "length", "changed"]
        stale = not stored.join(files, same, "left_anti").isEmpty()
        new = files if stale else files.join(stored, same, "left_anti")
        new = self.spark.createDataFrame(new.collect(), files.schema)  # names: Spark takes the files to read from the driver
        paths = [r["path"] for r in new.collect()]
        if paths or stale:
            load = read or (lambda p: read_news(self.spark, p, fmt, status, base=path))
            news = load(paths) if paths else self.read("articles", []).drop("key", "batch")
            self.add_articles(news, new, replace=stale)
        if topics is not None:
            self.add_topics(topics)
        return len(paths)

    def compact(self) -> None:
        """Fold the states of all batches into one part a table."""
        version, parts = self.live()
        if len(parts["cells"]) < 2:
            return
        batch = uuid.uuid4().hex
        self._store_states(merge_states(self.read("cells", parts["cells"]), "timestamp", "source"), batch)
        self._commit(version, {"cells": batch, "totals": batch}, {"cells": parts["cells"], "totals": parts["totals"]})

    # reports

    def _of(self, table: str, topics, keywords: Iterable[str] | None = None) -> DataFrame:
        rows = self.read(table).drop("batch")
        if isinstance(topics, DataFrame):
            rows = rows.join(topics.select("topic").distinct(), "topic", "left_semi")
        elif topics is not None:
            # literals reach the scan: row groups of other topics (and keywords) are skipped
            names = sorted({topics} if isinstance(topics, str) else set(topics))
            rows = rows.where(F.col("topic").isin(names))
            if keywords is not None:
                rows = rows.where(F.col("keyword").isin(sorted({*names, *keywords})))
        return rows

    def states(self, topics: str | Iterable[str] | DataFrame | None = None, keywords: Iterable[str] | None = None) -> DataFrame:
        """States per month and outlet of the stored ``topics``: what every report but the article list takes in place of hits.
        ``keywords`` (with named topics) reads these relations and the topics' own rows alone."""
        return self._of("cells", topics, keywords)

    def relations(self, topics: str | Iterable[str] | DataFrame | None = None, min_count: int = MIN_COUNT) -> DataFrame:
        """The relation sets of the stored ``topics`` with archive extremes."""
        return relations(self._of("totals", topics), min_count, extremes=True)

    def hits(self, topic: str, keywords: Iterable[str] | None = None) -> DataFrame:
        """The hits of one topic (stored or not) from postings and articles, as ``layout.read_hits``."""
        return hits_by_key(self.read("postings"), self.read("articles"), topic, self.min_mentions, keywords, by=("batch", "key"))
