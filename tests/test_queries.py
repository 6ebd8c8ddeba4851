"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from verify import NO_SQL, compare

CORE = [n for m in entry._MODULES if ".llm." not in m.__name__ for n in m.QUERIES]
#: Queries that SQL cannot express; each has tests of its own.
WITHOUT = {
    "d04_bitap", "d12_checksum", "d14_hashes", "g09_assign", "g11_equiv", "g11_classes", "g12_paths", "g13_paths", "g14_offsets", "g15_umeyama", "g17_align_score", "g18_pair_sets",
    "g20_clusters", "g23_dominators", "s09_files", "s18_random",
}


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, [name])[name] == (NO_SQL if name in WITHOUT else "")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
