"""Connected components must not depend on how links are dealt out."""

from __future__ import annotations

import random

from readtrail.llm import components as module
from readtrail.llm.components import components


def _raised(monkeypatch, frame, least: int) -> None:
    """Counts that come with a key are raised, as on a cluster that deals keys to more tasks."""
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(least, n) if cols else n, *cols))


def _chains(spark):
    links = [(10 * k + i + 1, 10 * k + i) for k in range(5) for i in range(9)]
    random.Random(3).shuffle(links)
    return spark.createDataFrame(links, "a long, b long"), [(n, n // 10 * 10) for n in range(50)]


def test_every_node_has_one_label_if_keys_go_to_more_tasks(spark, monkeypatch):
    links, expected = _chains(spark)
    _raised(monkeypatch, type(links), 7)
    assert sorted(map(tuple, components(links).collect())) == expected


def test_links_of_several_tasks(spark, monkeypatch):
    links, expected = _chains(spark)
    monkeypatch.setattr(module, "TASK_LINKS", 10)
    _raised(monkeypatch, type(links), 7)
    assert sorted(map(tuple, components(links).collect())) == expected
