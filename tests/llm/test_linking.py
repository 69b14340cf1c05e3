"""Texts of classes that no pair asks for stay where they are."""

from __future__ import annotations

import re

import pytest

from readtrail.llm import common, linking, neardup, parity
from readtrail.llm.common import perhaps_among
from tests.llm.test_neardup import edited

LONGS = "id long"


@pytest.fixture
def no_broadcasts(spark):
    """As with tables beyond the threshold: nothing is sent to all tasks but what the code sends itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def _plans(monkeypatch) -> dict[str, list[str]]:
    """Plans of the tables that `linking` stages, by their names."""
    plans: dict[str, list[str]] = {}

    def noted(df, name, stage=linking.staged):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(linking, "staged", noted)
    return plans


@pytest.mark.parametrize("groups", [parity.join_groups, neardup.near_groups])
def test_texts_are_not_shuffled_to_be_selected(documents, no_broadcasts, monkeypatch, groups):
    plans = _plans(monkeypatch)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(base, n, n) for n in range(3)] + [f"alone {k} " * (k + 5) for k in range(20)]
    found = {r.doc_id: r.component_id for r in groups(documents(*enumerate(texts))).collect()}
    assert [found[i] for i in range(4)] == [0, 0, 0, 3]
    selected = "\n".join(plans["texts"])
    assert "text" in selected and not re.search(r"hashpartitioning\((cid|_row)#", selected)
    assert plans["sets"] and all("BroadcastHashJoin" in p for p in plans["sets"])


def _ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], LONGS)


def test_perhaps_among_loses_no_id(spark):
    ends = [0, 1, -1, 2**63 - 1, -(2**63)]
    ids, others = [7 * i for i in range(5000)] + ends, [7 * i + 3 for i in range(20000)]
    rows = _ids(spark, ids + others + ids).repartition(3)
    passed = [r.id for r in perhaps_among(rows, _ids(spark, sorted(set(ids))), "id").collect()]
    assert sorted(x for x in passed if x in set(ids)) == sorted(ids + ids)
    assert len(passed) - 2 * len(ids) < len(others) / 10


def test_perhaps_among_with_a_full_table(spark, monkeypatch):
    """Beyond the largest table more rows pass, and none is lost."""
    monkeypatch.setattr(common, "MOST_BITS", 64)
    ids = list(range(200))
    passed = [r.id for r in perhaps_among(_ids(spark, range(400)), _ids(spark, ids), "id").collect()]
    assert set(ids) <= set(passed) and len(passed) == len(set(passed))


def test_perhaps_among_nothing(spark):
    assert perhaps_among(_ids(spark, [1, None]), _ids(spark, []), "id").collect() == []
    assert [r.id for r in perhaps_among(_ids(spark, [1, None]), _ids(spark, [1]), "id").collect()] == [1]
