"""Problem 5: compaction of small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codekin.plans.scratch import new_path
from codekin.sources.compaction import ConflictError, Store, compacted_graphs

SCHEMA = "gdl_id long, file_id long, title string, body string, written_at timestamp, part string, addr string, batch string, arrived int"
BODY = 'node: { title: "a" label: "x" }\n}'


def ids(spark, rows, **how):
    seen = [None, *[datetime(2011, m, 1) for m in (1, 4, 8)]]
    df = spark.createDataFrame([(*r, seen[i % 4], "clash", "clash", "clash", 1) for i, r in enumerate(rows)], SCHEMA)
    return sorted((r["gdl_id"] for r in compacted_graphs(df, **how).collect()), key=lambda x: (x is None, x))


def test_equal_records_are_kept_once(spark):
    rows = [
        (5, 1, "graph of 08049920", BODY), (2, 1, "Graph of 8049920", BODY), (9, 1, '"graph of 0x08049920"', BODY + "\n\n"),
        (7, 1, "  graph of 08049920 ", BODY.replace("\n", "\r\n")), (8, 1, "graph of 08049920", BODY.replace(" }\n", " } \t\n")),
        (3, 2, "graph of 08049920", BODY), (4, 1, "graph of 08049921", BODY), (6, 1, "graph of 08049920", "x\n" + BODY),
    ]
    assert ids(spark, rows) == [2, 3, 4, 6]


def test_what_is_no_record(spark):
    rows = [
        (1, 1, None, BODY), (2, 1, "  \t", BODY), (3, 1, "graph of 1", None), (4, 1, "graph of 1", ""), (5, 1, "graph of 1", " \n\n"),
        (6, 1, "graph of 1", 'node: { title: "a" }'), (7, 1, "graph of 1", BODY + "\nedge: {"), (8, None, "graph of 1", BODY), (None, 1, "graph of 2", BODY),
        (10, 1, "graph of 2", BODY), (None, 1, "graph of 3", BODY), (11, 1, "graph of 4", "}"), (12, 1, "graph of 00", BODY), (13, 1, "graph of 0", BODY),
    ]
    assert ids(spark, rows) == [8, 10, 11, 12, None]


def test_empty_and_long(spark):
    assert ids(spark, []) == []
    long = "node: x\n" * 200_000 + "}"
    assert ids(spark, [(1, 1, "graph of 1", long), (2, 1, "graph of 1", long + "\n"), (3, 1, "graph of 1", "y" + long)]) == [1, 3]


@pytest.mark.parametrize("target", [128, 512, 2048, 16384, 128 << 20])
def test_copies_go_whatever_the_size_of_files(spark, target):
    rows = [(i, i % 3, f"graph of {i % 5}", f"{'x' * (i % 2 * 700)}\n" + BODY) for i in range(1, 61)]
    assert ids(spark, rows, target_bytes=target) == list(range(1, 31))


def rows(spark, ids, parts=3):
    return spark.createDataFrame([(i,) for i in ids], "id long").select("id", (F.col("id") % parts).cast("int").alias("part")).coalesce(1)


def landed(spark, parts=3, files=4):
    store = Store(spark, new_path(spark, "store"))
    for k in range(files):
        store.append(rows(spark, range(k * 100, k * 100 + 100), parts))
    return store


def held(store, version=None):
    return sorted(r["id"] for r in store.read(version).collect())


def files(store, part):
    return {r["f"] for r in store.read().where(f"part = {part}").select(F.col("_metadata.file_path").alias("f")).collect()}


def test_only_partitions_with_many_small_files_are_rewritten(spark):
    store = landed(spark)
    store.append(spark.createDataFrame([(1000, 7)], "id long, part int").coalesce(1))
    before, kept = store.version(), files(store, 7)
    version, parts = store.compact(target_bytes=1 << 20, min_small_files=2)
    assert parts == [0, 1, 2] and version == before + 1
    assert files(store, 7) == kept
    assert held(store) == [*range(400), 1000] == held(store, before)
    assert {r["n_files"] for r in store.file_counts(1).collect()} == {1}
    assert store.compact(target_bytes=1 << 20, min_small_files=2) == (version, [])
    store.append(rows(spark, [2001, 2004]))
    assert store.compact(target_bytes=1 << 20, min_small_files=2)[1] == [0]
    assert held(store) == [*range(400), 1000, 2001, 2004]


def racing(monkeypatch, store, act):
    """Let ``act`` run after a change has written its files and before it commits."""
    commit = Store.commit

    def late(self, *args, **kwargs):
        monkeypatch.setattr(Store, "commit", commit)
        act()
        return commit(self, *args, **kwargs)

    monkeypatch.setattr(Store, "commit", late)


def test_rows_appended_during_a_compaction_stay(spark, monkeypatch):
    store = landed(spark)
    racing(monkeypatch, store, lambda: Store(spark, store.path).append(rows(spark, [900, 901, 902])))
    store.compact(target_bytes=1 << 20)
    assert held(store) == [*range(400), 900, 901, 902]


def test_second_compaction_of_the_same_files_is_refused(spark, monkeypatch):
    store = landed(spark)
    racing(monkeypatch, store, lambda: Store(spark, store.path).compact(target_bytes=1 << 20))
    with pytest.raises(ConflictError):
        store.compact(target_bytes=1 << 20)
    assert held(store) == [*range(400)] and store.version() == 5


def test_refused_append_is_invisible_and_can_be_repeated(spark, monkeypatch):
    store = landed(spark)
    since = store.version()
    racing(monkeypatch, store, lambda: Store(spark, store.path).append(rows(spark, [900])))
    with pytest.raises(ConflictError):
        store.append(rows(spark, [950]), expected=since)
    assert held(store) == [*range(400), 900]
    store.append(rows(spark, [950]), expected=store.version())
    assert held(store) == [*range(400), 900, 950]


def test_number_of_a_snapshot_is_given_once(spark):
    store = landed(spark, files=1)
    body = store.snapshot(1)
    assert not store._create(1, body | {"live": {}}) and store.snapshot(1) == body
    assert store._create(2, body) and store.version() == 2


def test_vacuum_removes_only_what_no_kept_snapshot_names(spark):
    store = landed(spark)
    before = store.version()
    store.compact(target_bytes=1 << 20)
    assert store.vacuum(keep=2 + before) == 0 and held(store, before) == [*range(400)]
    assert store.vacuum() == 12 and store.versions() == [before + 1]
    assert held(store) == [*range(400)]


def test_large_partition_becomes_several_files(spark):
    store = landed(spark, parts=1)
    store.compact(target_bytes=2_000)
    assert store.file_counts(1).collect()[0]["n_files"] > 1 and held(store) == [*range(400)]


def test_landing_makes_one_file_for_each_quarter_and_partition(spark):
    path = new_path(spark, "graphs")
    df = spark.createDataFrame([(i, 1, f"graph of {i:x}", BODY, datetime(2011, 1 + i % 3 * 3, 1), "", "", "", 1) for i in range(1, 301)], SCHEMA)
    assert compacted_graphs(df, path=path).count() == 300
    store = Store(spark, path)
    assert {r["n_files"] for r in store.file_counts(1, 1).collect()} == {3}
    assert {r["n_files"] for r in store.file_counts(1, 2).collect()} == {1}


def test_store_without_rows(spark):
    store = Store(spark, new_path(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    assert store.compact() == (0, [])
    store.append(rows(spark, []))
    assert held(store) == [] and store.compact() == (1, [])
