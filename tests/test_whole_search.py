"""Searches of all functions against all: no function is left out, and blocks of any size give what a plain loop gives."""

import math
import random
from datetime import datetime

import pytest

import __spark_entry__ as entry
from codekin.operators import distance, near_blocks
from verify import compare

OPS = ["mov", "add", "push", "call", "mov", "add", "push", "xor", "mov", "add"]


@pytest.fixture(scope="module")
def no_fiftieth(spark, tmp_path_factory):
    """Functions of two files of which no id is divisible by 50."""
    root = tmp_path_factory.mktemp("no_fiftieth")
    own = [(50 * k + f, f, f"copy_{k % 3}", ["free", "malloc"][: k % 3]) for k in range(8) for f in (1, 2)]
    rows = {
        "func": ("func_id long, file_id long, func_name string, startea long, endea long, func_size long, cyccomp int, num_vars int, num_params int, num_ngrams long, call_level int, compo int",
                 [(i, f, n, i * 64, i * 64 + 32, 32, 10, 0, 0, 8, None, None) for i, f, n, _ in own]),
        "bin_file": ("file_id long, client_id int, file_path string, file_name string", [(f, f, f"/node/bin/f{f}", f"f{f}") for f in (1, 2)]),
        "ir_func": ("func_id long, file_id long, fn_name string, calls array<string>", own),
        "ir_bb": ("bb_id long, func_id long, bb_no int, stmts array<string>", [(i, i, 0, [f"/* {o} a,b */" for o in OPS]) for i, *_ in own]),
        "gdl_file": ("gdl_id long, file_id long, title string, body string, written_at timestamp", [(f, f, "graph", "x\n}", datetime(2011, 1, f)) for f in (1, 2)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", ["a03_report2", "f01_gates", "j03_results", "j04_other_names"])
def test_every_function_is_searched_for(spark, no_fiftieth, name, capsys):
    assert compare(spark, no_fiftieth, [name])[name] == ""
    assert int(capsys.readouterr().out.split(f"{name}: ")[1].split(" rows")[0]) >= 2
    assert "func_id % 50" not in entry.oracle_sql()[name]


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(7)
    own = []
    for k in range(120):
        terms = {g: rng.randint(1, 4) for g in ["common", *rng.sample("abcdefgh", rng.randint(0, 5))]}
        n, c = rng.choice([None, 0, 0, 1, 2, 3, 4, 7, 9, 10, 30]), rng.choice([None, 1, 5, 9, 10, 11, 12, 20])
        own.append((k, rng.choice([None, 1, 2, 3]), n, c, rng.choice([None, "x", "x", "y", "z"]), rng.sample(["free", "malloc", "exit"], rng.randint(0, 3)), terms if k % 11 else {}))
    fn = spark.createDataFrame(
        [(i, f, n, c, name, calls, len(calls)) for i, f, n, c, name, calls, _ in own],
        "func_id long, file_id long, num_ngrams long, c int, func_name string, names array<string>, i long",
    )
    vectors = spark.createDataFrame([(r[0], list(r[6]), list(r[6].values())) for r in own if r[6]], "func_id long, terms array<string>, freqs array<long>")
    return own, fn, vectors


def _loop(own, names):
    for i1, f1, n1, c1, a1, s1, v1 in own:
        for i2, f2, n2, c2, a2, s2, v2 in own:
            if None in (f1, f2, n1, n2, c1, c2) or f1 == f2 or n2 > 3 * n1 or n1 > 3 * n2 or not v1 or not v2:
                continue
            if names != "any" and (a1 is None or a2 is None or (a1 == a2) != (names == "same")):
                continue
            squares = [sum(x * x for x in v.values()) for v in (v1, v2)]
            d = math.floor((1 - sum(x * v2.get(g, 0) for g, x in v1.items()) / (math.sqrt(squares[0]) * math.sqrt(squares[1]))) * 1e6 + 0.5) / 1e6
            if d < 0.4 and c1 <= c2 + max(2, math.floor(0.2 * c1)) and len(s1) <= len(s2):
                yield i1, i2, d, a1, f2, len({*s1} & {*s2})


SMALL = {"FUNCTIONS_A_BAND": (3, 5), "QUERIES_A_STEP": 3, "FUNCTIONS_A_STEP": 4, "PAIRS_A_STEP": 2, "COMMON": 2, "GROUPS": 2, "ROWS_A_BATCH": 3, "HEAVY_NAME": 35}


@pytest.mark.parametrize("names", ["any", "other", "same"])
@pytest.mark.parametrize("small", [False, True])
def test_blocks_of_any_size_give_what_a_loop_gives(spark, drawn, monkeypatch, names, small):
    own, fn, vectors = drawn
    for name, value in SMALL.items() if small else ():
        monkeypatch.setattr(near_blocks, name, value)
    if names == "same":
        fn = fn.join(fn.where("func_name IS NOT NULL").groupBy("func_name").count().withColumnRenamed("count", "n_named"), "func_name")
        assert {r[0] > 35 for r in fn.select("n_named").collect()} == {True, False}
    search = near_blocks.Search(0.4, 3, names, ("func_name",), ("file_id",), True)
    got = [tuple(r) for r in distance.near_among(fn, vectors, search).collect()]
    assert sorted(got, key=repr) == sorted(_loop(own, names), key=repr) and len(got) > 20


def test_zeros_have_the_sign_of_sql(spark):
    fn = spark.createDataFrame([(k, k, 3, 1, None, [], 0) for k in (1, 2)], "func_id long, file_id long, num_ngrams long, c int, func_name string, names array<string>, i long")
    vectors = spark.createDataFrame([(k, ["a", "b", "c"], [1, 1, 1]) for k in (1, 2)], "func_id long, terms array<string>, freqs array<long>")
    assert [str(r["value"]) for r in distance.near_among(fn, vectors, near_blocks.Search(0.4, 3)).collect()] == ["-0.0", "-0.0"]


def test_pairs_of_a_name_start_from_names(spark, no_fiftieth, monkeypatch):
    met, meet = [], near_blocks._meet
    monkeypatch.setattr(near_blocks, "_meet", lambda rows, band, to, *more: met.append(to) or meet(rows, band, to, *more))
    entry.queries()["a03_report2"](spark, no_fiftieth)
    assert len(met) == 1 and all(len(blocks) == 1 for blocks in met[0])
