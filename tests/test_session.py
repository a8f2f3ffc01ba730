"""Lifetime of scratch tables, scoped persistence."""

import os

import pytest

from cotopic.operators import relations, topic_hits
from cotopic.session import persisted, scratch_path, scratch_scope
from cotopic.plans.report import relation_detail, topic_search
from cotopic.sources.news import materialize
from cotopic.sources.store import RelationStore


def there(path):
    return os.path.exists(path.removeprefix("file:"))


def test_a_scope_drops_its_tables(spark, hand):
    with scratch_scope(spark) as scope:
        a = scratch_path(spark, "inside")
        materialize(hand, a)
        with scratch_scope(spark) as inner:
            b, c = scratch_path(spark, "deep"), scratch_path(spark, "kept")
            materialize(hand, b)
            materialize(hand, c)
            inner.keep("kept")
        assert there(a) and there(c) and not there(b)
        assert set(scope.paths) == {a, c}
    assert not there(a) and not there(c)


def test_also_after_a_failure(spark, hand):
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark):
            a = scratch_path(spark, "inside")
            materialize(hand, a)
            1 / 0
    assert not there(a)


def test_searches_and_stores_leave_nothing(spark, hand):
    with scratch_scope(spark) as scope:
        search = topic_search(hand, "q")
        assert relation_detail(search, "a")["summary"].count() == 1
        paths = list(scope.paths)
    assert len(paths) == 2 and not any(map(there, paths))
    root = scratch_path(spark, "store")
    before = set(os.listdir(os.path.dirname(root.removeprefix("file:"))))
    RelationStore(spark, root).get_or_compute(hand, ["q", "a"])
    after = set(os.listdir(os.path.dirname(root.removeprefix("file:"))))
    assert after - before == {os.path.basename(root)}  # the store alone


def test_persisted_is_released(spark, hand):
    rel = relations(topic_hits(hand, "q"))
    with persisted(rel) as kept:
        assert kept.count() == 4 and kept.storageLevel.useMemory
    assert not rel.storageLevel.useMemory
