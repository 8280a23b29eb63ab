"""Every registered query of the core against SQL on the same tables."""

import pathlib
import re

import oracle
import pytest

from marginalia.plans import batches, numbered, retrieval, rollups, store, upkeep

REGISTRIES = [numbered.registry, store.registry, retrieval.registry, rollups.registry, batches.registry, upkeep.registry]
NAMES = [n for r in REGISTRIES for n in r.queries]
#: Cutting by bytes is beyond SQL; see test_chunks.py.
NO_SQL = {"i01_chunks"}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, duck, name):
    what, count, _ = oracle.compare(spark, duck, name, small)
    assert what == ("no sql" if name in NO_SQL else "ok")


def test_all_have_sql_and_names_are_apart():
    assert len(NAMES) == len(set(NAMES))
    assert {n for r in REGISTRIES for n in r.queries if n not in r.sql} == NO_SQL


def test_nothing_else_imports_the_text_package():
    root = pathlib.Path(oracle.__file__).parent.parent / "marginalia"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+marginalia\.llm", p.read_text(), re.M), p
