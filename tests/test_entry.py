"""The driver's entry with and without the training-data package."""

from __future__ import annotations

import sys

import __spark_entry__ as entry
from memgrid.plans import registry


def test_library_queries_stand_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "memgrid.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracles())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
