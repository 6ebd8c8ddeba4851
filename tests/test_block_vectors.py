"""Vectors from blocks: equal to the SQL on odd rows, and no statement is shuffled by the searches."""

import duckdb
import pytest

import __spark_entry__ as entry
from codekin.operators import block_vectors, distance, pair_blocks
from codekin.operators.features import with_views

SEARCHES = ["a03_report2", "j03_results", "t01_topk", "a03_report3", "g09_assign", "j04_other_names", "d01_cosim", "d02_euclid", "j03_star"]

#: bb_id, func_id, bb_no, stmts
ROWS = [
    (1, 1, 0, ["a = 1", "b = 2", "c = 3", "a = 1"]), (1, None, None, None), (1, 1, 0, ["a = 1", "b = 2", "c = 3", "a = 1"]),  # redelivered
    (2, 1, 1, ["b = 2", None, "/* mov x */", "?"]), (3, 1, None, ["a = 9", "b = 2", "c = 3"]),  # null statement, null number
    (4, 2, 0, ["a = 1", "b = 1", "c = 1"]), (4, 2, 0, ["z = 1", "b = 1", "c = 1"]), (4, 2, 0, None), (5, 2, 1, ["a = 1"] * 4),  # statements differ
    (6, 3, 0, ["a = 1"]), (7, 3, 0, ["b = 1"]), (8, 4, 0, None), (9, 5, 0, []), (10, None, 0, ["a = 1"] * 3), (None, 6, 0, ["a = 1"] * 3),
    (11, 7, 0, None), (11, 8, 0, ["a = 1"] * 3), (12, 9, 0, ["a = 1"] * 3), (12, 9, 0, ["b = 1"]),  # two functions; the greatest list has no n-gram
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, "bb_id long, func_id long, bb_no int, stmts array<string>").repartition(3).write.parquet(f"{folder}/ir_bb.parquet")
    return folder


@pytest.mark.parametrize("how", ["left", "inner"])
def test_vectors_of_odd_blocks(spark, odd, how):
    fn = spark.range(1, 12).selectExpr("id AS func_id", "id % 3 AS file_id", "5L AS num_ngrams", "concat('f', id) AS name")
    rows = distance._packed(fn.where("func_id = 3"), fn, block_vectors.block_rows(spark, odd), ("name",), True, how).collect()
    got = {(r["func_id"], g, f) for r in rows for g, f in zip(r["terms"], r["freqs"])}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW ir_bb AS SELECT * FROM read_parquet('{odd}/ir_bb.parquet/*.parquet')")
    assert got == set(con.execute(with_views("SELECT * FROM fq", "bb", "st", "op", "gr", "fq")).fetchall())
    assert sorted(r["func_id"] for r in rows) == (list(range(1, 12)) if how == "left" else sorted({g[0] for g in got}))
    assert all(r["name"] == f"f{r['func_id']}" and r["is_query"] == (r["func_id"] == 3) for r in rows)


@pytest.mark.parametrize("name", SEARCHES)
def test_no_statement_is_shuffled(spark, sf_dir, monkeypatch, name):
    plans, kept = [], distance.written

    def seen(df, table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, table)

    monkeypatch.setattr(distance, "written", seen)
    entry.queries()[name](spark, sf_dir)
    assert any("stmts" in p for p in plans) and not any("max(stmts" in p for p in plans)


def test_queries_go_to_few_blocks(spark, monkeypatch):
    met, meet = [], pair_blocks.meet
    monkeypatch.setattr(pair_blocks, "meet", lambda rows, *more: met.append(rows) or meet(rows, *more))
    fn = spark.createDataFrame([(i, i, n) for i, n in enumerate([0, 1, 2, 3, 9, 10, 20, 27, 30, 31, 80, 90])], "func_id long, file_id long, num_ngrams long")
    freq = spark.createDataFrame([(i, ["a"], [1]) for i in range(12)], "func_id long, terms array<string>, freqs array<long>")
    got = distance.distances("cosim", fn, fn, freq).select("func1_id", "func2_id").collect()
    n = [r["num_ngrams"] for r in fn.sort("func_id").collect()]
    assert {tuple(r) for r in got} == {(i, j) for i, x in enumerate(n) for j, y in enumerate(n) if i != j and x <= 3 * y and y <= 3 * x}
    ten = {r["__bucket"] for r in met[0].where("__side = 0").collect() if 10 in pair_blocks.unpacked(r["__rows"])["n"].to_pylist()}
    assert len(ten) < len({r["__bucket"] for r in met[0].where("__side = 1").collect()}) - 2 and len(ten) <= 5
    assert pair_blocks._rows_a_block(pair_blocks.QUERIES_A_CUT + 1) == pair_blocks.FUNCTIONS_A_BLOCK[1]
