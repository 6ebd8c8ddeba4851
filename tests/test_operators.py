"""Small golden and property tests of the core's operators."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codekin.functions import scalars
from codekin.operators import distance, distance_queries, equivalence, gates, graph, matching, results, tabular_queries, writes
from codekin.sources import formats


def substring_distance(pattern, text):
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i - 1] + (p not in (c, ".")), column[i] + 1, new[-1] + 1))
        column = new
        best = min(best, column[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab.", max_size=12), st.text("ab", max_size=20), st.floats(0, 1))
def test_approximate_find(pattern, text, share):
    want = substring_distance(pattern, text)
    assert distance.approximate_find(pattern, text, share) == (want if want <= int(share * len(text)) else -1)


@pytest.mark.parametrize("rows, queries", [(500, 2000), (3, 2)])
def test_edit_pairs_equal_direct_search(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(distance, "QUERIES_A_BLOCK", queries)
    rng = random.Random(8)
    words = ["mem", "xor", "mov", "."]  # xor and mem share the first digit of their md5
    texts = [[rng.choice(words[:3]) for _ in range(rng.randint(20, 40))] for _ in range(6)]
    codes = [t[rng.randint(0, 5) :] for t in texts for _ in range(4)] + [[], ["mov"], [""], [".", "xor", "."], ["mem"] * 20, ["xor"] * 20]
    fn = [(i, i % 3, rng.choice([0, 5, 9, None]), "".join(w + " " for w in c)) for i, c in enumerate(codes)]
    df = spark.createDataFrame(fn, "func_id long, file_id long, num_ngrams long, code string")
    want = {}
    for i, f1, n1, c1 in fn:
        for j, f2, n2, c2 in fn:
            if f1 != f2 and n1 is not None and n2 is not None and n1 <= 3 * n2 and n2 <= 3 * n1 and not i % 2:
                want[i, j] = distance.approximate_find(c1.split(" ")[:-1], c2.split(" ")[:-1])
    got = [tuple(r) for r in distance.edit_pairs(df.where("func_id % 2 = 0"), df, rows_a_task=rows).collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want and {0, -1} < set(want.values())
    assert distance.edit_pairs(df.limit(0), df.limit(0)).count() == 0


def test_ratio_pairs_in_parts(spark):
    fn = spark.createDataFrame([(i, i % 3, i) for i in range(40)], "func_id long, file_id long, num_ngrams long")
    once, cut = (sorted(tuple(r) for r in distance.ratio_pairs(fn, fn, carry=("num_ngrams",), rows_a_task=n).collect()) for n in (100, 3))
    assert once == cut and len(once) == sum(a <= 3 * b and b <= 3 * a and a % 3 != b % 3 for a in range(40) for b in range(40))


def test_counts_of_zero_match_each_other_only(spark):
    fn = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, None), (5, 5, -2)], "func_id long, file_id long, num_ngrams long")
    pairs = lambda **how: sorted(tuple(r) for r in distance.ratio_pairs(fn, fn, other_file=False, **how).collect())
    assert pairs() == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)] and pairs(least=1) == [(3, 3)]


@pytest.mark.parametrize("share", [0.001, 0.9])
def test_near_pairs_against_brute_force(spark, monkeypatch, share):
    rng = random.Random(3)
    monkeypatch.setattr(distance, "HEAVY_SHARE", share)
    vectors = {i: {g: rng.randint(1, 4) for g in ["common", *rng.sample("abcdefgh", rng.randint(0, 6))]} for i in range(40)}
    fn = spark.createDataFrame([(i, i % 4, len(v)) for i, v in vectors.items()] + [(99, 9, 0)], "func_id long, file_id long, num_ngrams long")
    freq = spark.createDataFrame([(i, g, f) for i, v in vectors.items() for g, f in v.items()], "func_id long, ngram string, freq long")
    got = {(r[0], r[1]): r[2] for r in distance.near_pairs(fn.where("func_id % 5 = 0"), fn, freq, 0.4).collect()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = {}
    for i, a in vectors.items():
        for j, b in vectors.items():
            d = round(1 - sum(x * b.get(g, 0) for g, x in a.items()) / norm(a) / norm(b), 6)
            if i % 5 == 0 and i % 4 != j % 4 and len(a) <= 3 * len(b) and len(b) <= 3 * len(a) and d < 0.4:
                want[i, j] = d
    assert got == pytest.approx(want, abs=1e-6) and want


def test_bitap_gives_every_pair(spark, sf_dir):
    import __spark_entry__ as entry

    queries, fn, _ = distance_queries._base(spark, sf_dir)
    ops = distance_queries.operations(spark, sf_dir).select("func_id")
    pairs = distance.ratio_pairs(queries.join(ops, "func_id"), fn.join(ops, "func_id"))
    assert pairs.exceptAll(entry.queries()["d04_bitap"](spark, sf_dir).select("func1_id", "func2_id")).count() == 0 < pairs.count()


@pytest.mark.parametrize("a, b, d", [("", "", 0), ("abc", "acb", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("ab", "ba", 1), ("", "xy", 2)])
def test_damerau(a, b, d):
    assert distance.damerau(a, b) == d == distance.damerau(b, a)


def test_distances_are_symmetric_and_bounded(spark):
    freq = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 4), (2, "b", 2), (3, "c", 5)], "func_id long, ngram string, freq long")
    fn = spark.createDataFrame([(i, i, 5) for i in (1, 2, 3, 4)], "func_id long, file_id long, num_ngrams long")
    for name, want in {"cosim": {(1, 2): 0.0, (1, 3): 1.0, (1, 4): 1.0}, "euclid": {(1, 2): 2.236068, (1, 4): 2.236068, (3, 4): 5.0}, "mahal": {(1, 3): 8.573214, (1, 4): None}}.items():
        got = {(r["func1_id"], r["func2_id"]): r["value"] for r in distance.distances(name, fn, fn, freq).collect()}
        assert all(got[a, b] == got[b, a] == got[k] for k in want for a, b in [k])
        assert {k: got[k] for k in want} == want
    assert np.isinf({(r["func1_id"], r["func2_id"]): r["value"] for r in distance.distances("mahal", fn, fn, spark.createDataFrame([(1, "a", 2), (2, "a", 3)], freq.schema)).collect()}[1, 2])


def test_assignment_golden_and_brute_force():
    cost = np.array([[62, 75, 80, 93, 95, 97], [75, 80, 82, 85, 71, 97], [80, 75, 81, 98, 90, 97], [78, 82, 84, 80, 50, 98], [90, 85, 85, 80, 85, 99], [65, 75, 80, 75, 68, 96]])
    rng = random.Random(3)
    for c in [cost, *[np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]) for n, m in ((1, 1), (3, 3), (4, 6), (5, 5))]]:
        for most in (False, True):
            to = matching.assignment(c, maximise=most)
            assert len(set(to)) == len(to)
            best = (max if most else min)(sum(c[i, p[i]] for i in range(len(c))) for p in itertools.permutations(range(c.shape[1]), len(c)))
            assert c[range(len(c)), to].sum() == best


def test_umeyama_golden():
    a = np.array([[0, 3, 4, 2], [0, 0, 1, 2], [1, 0, 0, 1], [0, 0, 1, 0]])
    b = np.array([[0, 4, 2, 4], [0, 0, 1, 0], [0, 2, 0, 2], [0, 1, 2, 0]])
    match, score = matching.umeyama(a, b)
    assert sorted(match) == [0, 1, 2, 3]
    best = min(((a[np.ix_(p, p)] - b) ** 2).sum() for p in itertools.permutations(range(4)))
    assert score == pytest.approx(((a[np.ix_(match, match)] - b) ** 2).sum()) and score <= 3 * best
    order = [2, 0, 3, 1]
    assert matching.umeyama(a, a[np.ix_(order, order)])[1] == pytest.approx(0)
    assert matching.umeyama(a, np.zeros((0, 0)))[1] == (a**2).sum()
    assert matching.umeyama(np.pad(a, (0, 2)), a)[1] == pytest.approx(0) == matching.umeyama(a, np.pad(a, (0, 2)))[1]


def test_paths_and_equivalence():
    assert equivalence.paths(1, {1: [2, 3], 2: [4], 3: [4], 4: []}) == ([[1, 2, 4], [1, 3, 4]], False)
    assert equivalence.paths(1, {1: []}) == ([[1]], False) and equivalence.paths(9, {1: []}) == ([], False)
    found, _ = equivalence.paths(1, {1: [2], 2: [1, 3], 3: []})
    assert [1, 2, 3] in found and all(p.count(b) <= 4 for p in found for b in p)
    assert len(equivalence.paths(0, {i: [2 * i + 1, 2 * i + 2] if i < 1023 else [] for i in range(2047)})[0]) == 500
    r = "R_EAX:reg32_t = R_EBX:reg32_t + R_ECX:reg32_t;"
    swapped = "R_EAX:reg32_t = R_ECX:reg32_t + R_EBX:reg32_t;"
    less = "R_EAX:reg32_t = R_EBX:reg32_t - R_ECX:reg32_t;"
    assert equivalence.compare_paths([[r]], [[r]]) == "TRUE"
    assert equivalence.compare_paths([[r]], [[swapped]]) == "UNKNOWN"
    assert equivalence.compare_paths([[r]], [[less]]) == "FALSE"
    assert equivalence.compare_paths([[r]], [["mem[0x1:reg32_t]:reg32_t = R_EAX:reg32_t;"]]) == "MISMATCH"
    assert equivalence.compare_paths([["R_EAX:reg32_t = what;"]], [[r]]) == "ERR_IR"
    # statements in another order have the same outputs
    assert equivalence.Paths([[r]]).outputs(float("inf")) == equivalence.Paths([[swapped]]).outputs(float("inf"))
    assert equivalence.status(equivalence.Paths([[r] * 100]), equivalence.Paths([[swapped] * 100]), seconds=-1) == "TIMEOUT"
    assert equivalence.output_orders([1, 2, 3], [3, 1, 2]) == (1, 2, 0) and equivalence.output_orders([1], [2]) is None


def test_classes_of_a_name_carry_every_pair(spark):
    # 2 and 3 agree with each other, not with 1, the first of their name; 1 and 4 differ by a label only
    bodies = {1: "R_EAX:reg32_t = 0x1:reg32_t;", 2: "R_EAX:reg32_t = 0x2:reg32_t;", 3: "R_EAX:reg32_t = 0x2:reg32_t;", 4: "R_EAX:reg32_t = 0x1:reg32_t;", 5: "R_EBX:reg32_t = 0x2:reg32_t;"}
    blocks = spark.createDataFrame([(10 * f, f, 0, [f"label pc_0x{f}:", s]) for f, s in bodies.items()], "bb_id long, func_id long, bb_no int, stmts array<string>")
    names = spark.createDataFrame([(f, "n" if f < 5 else "m") for f in bodies], "func_id long, fn_name string")
    texts = equivalence.function_texts(graph.control_flow(blocks), blocks)
    classes = equivalence.name_classes(names, equivalence.text_keys(texts))
    assert {r["func_id"]: r["class_id"] for r in classes.collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}
    for side in (1, 32):  # in one row or cut into parts
        rows = sorted(tuple(r) for r in equivalence.class_statuses(classes, texts, side).collect())
        assert rows == [(1, 2, "FALSE"), (1, 4, "TRUE"), (2, 1, "FALSE"), (2, 3, "TRUE")]


def test_graph_operators(spark):
    v = spark.createDataFrame([(i, 1, 100 * i) for i in range(1, 8)], "func_id long, file_id long, startea long")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 6), (6, 6), (1, 2), (1, 99)], "fn_parent long, fn_child long")
    edges = graph.graph_edges(e, v)
    assert edges.count() == 6
    assert {r["func_id"]: r["component"] for r in graph.components(v, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert {r["func_id"]: r["level"] for r in graph.call_levels(v, edges).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1, 7: 0}
    assert {r["func_id"]: r["rank"] for r in graph.ranks(v, edges).collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 0}
    assert {(r["src"], r["dst"]): r["hops"] for r in graph.reachable(edges).collect()}[1, 4] == 3
    empty = spark.createDataFrame([], "fn_parent long, fn_child long")
    assert graph.components(v, empty).where("func_id <> component").count() == 0


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    v = spark.createDataFrame([(i,) for i in [*range(1, 201), *range(1000, 1300)]], "func_id long")
    got = graph.components(v, spark.createDataFrame(chain, "fn_parent long, fn_child long"))
    assert {r["component"] for r in got.collect()} == {1, 1000}


def test_components_never_return_unfinished_labels(spark):
    v, chain = spark.range(20).withColumnRenamed("id", "func_id"), [(i, i + 1) for i in range(19)]
    with pytest.raises(RuntimeError):
        graph.components(v, spark.createDataFrame(chain, "fn_parent long, fn_child long"), rounds=1)


def test_propagation_ends_when_nothing_changes(spark):
    v = spark.createDataFrame([(i, 1000.0) for i in range(12)] + [(20, 10.0), (21, 30.0)], "func_id long, size double")
    e = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(20, 21), (21, 20)], "fn_parent long, fn_child long")
    got = {r["func_id"]: r["w"] for r in graph.propagated(v, e, "size").collect()}
    want = [1000.0]
    for _ in range(11):
        want.append((0.3 * want[-1] + 700) / 2)
    assert [got[i] for i in range(11, -1, -1)] == pytest.approx(want, abs=1e-6)
    assert got[20] == pytest.approx((0.3 * got[21] + 7) / 2, abs=1e-6) and got[21] == pytest.approx((0.3 * got[20] + 21) / 2, abs=1e-6)


def test_qt_clusters():
    assert graph.qt_clusters([0, 5, 10, 100, 104, 300], 10) == [1, 1, 1, 2, 2, 3] and graph.qt_clusters([], 10) == []


def test_control_flow(spark):
    rows = [(1, 1, 0, ["a", "cjmp(T:reg1_t,name(pc_0x10),name(L_0));"]), (2, 1, 1, ["jmp(name(pc_0x99));"]), (3, 1, 2, ["label pc_0x10:", "b"]), (4, 2, 0, [])]
    flow = graph.control_flow(spark.createDataFrame(rows, "bb_id long, func_id long, bb_no int, stmts array<string>"))
    assert {r["bb_id"]: (r["next1"], r["next2"]) for r in flow.collect()} == {1: (2, 3), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_range_join(spark):
    points = spark.createDataFrame([(1, a) for a in (0, 9, 10, 4095, 4096, 9000)], "f long, address long")
    ranges = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 5000, "b"), (1, 7, 7, "none"), (2, 0, 9999, "other")], "f long, lo long, hi long, name string")
    got = sorted((r["address"], r["name"]) for r in graph.range_join(points, ranges, ["f"], "address", "lo", "hi").collect())
    assert got == [(0, "a"), (9, "a"), (10, "b"), (4095, "b"), (4096, "b")]


def test_scalars(spark):
    row = spark.createDataFrame([("a\t'b", "0f38aa", "ELF 64-bit LSB")], "t string, code string, kind string").select(
        scalars.escape_controls(F.col("t")).alias("t"), scalars.opcode_length(F.col("code")).alias("n"), scalars.bitness(F.col("kind")).alias("bits"),
        scalars.fnv1a(F.lit("a")).alias("fnv"), scalars.fnv1a(F.lit("")).alias("fnv0"), scalars.murmur3(F.lit("abc")).alias("m"),
        scalars.opcode_hex(F.array(F.lit(15), F.lit(258))).alias("hex"), scalars.machine_op("sar", F.lit(0x80000000), F.lit(4)).alias("sar"),
        scalars.machine_op("shl", F.lit(1), F.lit(40)).alias("shl"), scalars.machine_op("div", F.lit(7), F.lit(0)).alias("div"),
    ).first()
    assert row.asDict() == {"t": "a\\09\\27b", "n": 3, "bits": 64, "fnv": 0xE40C292C, "fnv0": 0x811C9DC5, "m": 0xB3DD93FA, "hex": "000f0102", "sar": 0xF8000000, "shl": 0, "div": 0xFFFFFFFF}


def test_gates(spark):
    rows = [(["push %ebp", "mov %esp,%ebp"],), (["push %ebp", "mov $0xffffffff,%ecx", "mov %esp,%ebp"],), (["push %ebp"],), ([],), (None,), (["push %eax", "mov %esp,%ebp"],)]
    df = spark.createDataFrame(rows, "i array<string>")
    assert [r[0] for r in df.select(gates.has_prologue(F.col("i"))).collect()] == [True, True, False, False, False, False]
    c = spark.createDataFrame([(10, 8), (10, 7), (50, 40), (50, 39), (None, 1)], "a int, b int")
    assert [r[0] for r in c.select(gates.complexity_gate(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 0), (3, None, 1)], "k long, v string, at long")
    assert sorted(tuple(r) for r in writes.upsert(old, new, ["k"], "at").collect()) == [(1, "a", 1), (2, "c", 2), (3, None, 1)]
    assert [r["k"] for r in writes.insert_ignore(old, new, ["k"]).collect()] == [3]
    ids = writes.dense_ids(spark.createDataFrame([(f"n{i % 50:02d}",) for i in range(500)] + [(None,)], "n string"), "n", 21).collect()
    assert sorted((r["n"], r["id"]) for r in ids) == [(f"n{i:02d}", 21 + i) for i in range(50)]
    assert writes.dense_ids(old.where("k > 5"), "v").count() == 0


def test_formats(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, "x")], "a long, b long, c string")
    formats.write_dot(e, "a", "b", str(tmp_path / "dot"), ["c"])
    assert [tuple(r) for r in formats.read_dot(spark, str(tmp_path / "dot"), ["c"]).collect()] == [("1", "2", "x")]
    s = formats.signatures(spark.createDataFrame([("5589E5........B8 08 8ED9 009C :0000 _vuln :002E _other ^0014 _strcpy",), ("---",)], "value string")).first()
    assert (s["pattern"], s["crc_length"], s["length"], s["names"]) == ("5589E5........B8", 8, 156, ["0000 _vuln", "002E _other"])
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"\x7fELFx")
    (tmp_path / "f" / "b.bin").write_bytes(b"text")
    assert [(r["name"], r["size"]) for r in formats.files_in(spark, str(tmp_path / "f"), magic=b"\x7fELF").collect()] == [("a.bin", 5)]
    assert formats.random_graph(spark, 10, 100).count() == 100


def test_dominators_and_loops():
    flow = {1: [2, 3], 2: [4], 3: [4], 4: [2, 5], 5: [5, 6], 6: [], 9: [1]}
    assert graph.dominators(1, flow) == {2: 1, 3: 1, 4: 1, 5: 4, 6: 5}
    assert graph.loop_heads(1, flow) == {5} and graph.loop_heads(1, {1: [2], 2: [3], 3: [2, 1]}) == {1, 2}
    assert graph.dominators(1, {1: []}) == {}


def test_edit_bound():
    a = np.array([[0, 1], [0, 0]])
    assert matching.edit_bound(a, a) == 0 == matching.edit_bound(a, a.T) and matching.edit_bound(a, np.zeros((0, 0))) == 3
    assert matching.edit_bound(a, np.pad(a, (0, 1))) == 1


def test_large_graphs_keep_their_rows(spark):
    chain = [(1, v, v + 1) for v in range(6)]
    small = [(2, 10, 11), (2, 11, 12), (3, 20, 21), (3, 20, 20)]
    edges = spark.createDataFrame(chain + small, "file_id long, fn_parent long, fn_child long")

    def rows(file, **limits):
        subject = edges.where(F.col("file_id") == file).groupBy(F.col("file_id").alias("file1")).agg(F.collect_list(F.struct("fn_parent", "fn_child")).alias("e1"))
        return {r["file2"]: r for r in matching.spectral_matches(edges, subject, **limits).collect()}

    whole = rows(1)
    assert set(whole) == {2, 3} and all(r["score"] is not None for r in whole.values())
    large = rows(1, most=5)  # the subject is too large: no score, but rows and bounds
    assert {k: (r["score"], r["n_edits"], r["n1"], r["n2"]) for k, r in large.items()} == {k: (None, r["n_edits"], 7, r["n2"]) for k, r in whole.items()}
    other = rows(2, most=5)  # one of the others is
    assert other[1]["score"] is None and other[3]["score"] == rows(2)[3]["score"] is not None
    assert [r["n_edits"] is None for _, r in sorted(rows(1, most_cells=15).items())] == [True, False]


def test_recursion(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 4), (2, 5, 6)], "file_id long, fn_parent long, fn_child long")
    assert sorted(r["func_id"] for r in graph.recursive_functions(e).collect()) == [2, 3, 4]
    assert graph.recursive_functions(e.where("file_id > 5")).count() == 0


def test_register_offsets():
    s = ["T_1:reg32_t = R_ESP:reg32_t + 0x8:reg32_t;", "T_2:reg32_t = T_1:reg32_t - 0xc:reg32_t;", "R_EAX:reg32_t = T_2:reg32_t;", "T_1:reg32_t = mem[R_EBX:reg32_t]:reg32_t;", "R_ECX:reg32_t = T_1:reg32_t;"]
    assert equivalence.register_offsets(s) == {"T_2": ("R_ESP", -4), "R_EAX": ("R_ESP", -4)}
    assert equivalence.register_offsets([]) == {}


def test_database(spark, tmp_path):
    from codekin.sources import database

    spark.range(5).write.parquet(str(tmp_path / "a" / "t.parquet"))
    database.dump(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["t"])
    (tmp_path / "b" / "t.parquet" / "bad.parquet").write_bytes(b"no parquet")
    spark.range(0).write.mode("append").parquet(str(tmp_path / "b" / "t.parquet"))
    kept, damaged = database.repair(spark, str(tmp_path / "b"), str(tmp_path / "c"), "t")
    assert kept == 5 and [d.rsplit("/", 1)[1] for d in damaged] == ["bad.parquet"]
    assert database.load(spark, str(tmp_path / "c"), ["t"])["t"].count() == 5
    database.truncate(spark, str(tmp_path / "c"), "t")
    assert spark.read.parquet(str(tmp_path / "c" / "t.parquet")).count() == 0


def bit_vector(op, a, b, c):
    """Machine operations on 32 bits in plain integers."""
    m = 1 << 32
    s, d = (x - m if x >= m // 2 else x for x in (a, b))
    quotient, rest = (0, 0) if not b else (abs(s) // abs(d) * (1 if (s < 0) == (d < 0) else -1), abs(s) % abs(d) * (-1 if s < 0 else 1))
    return {
        "not": ~a, "neg": -a, "add": a + b, "sub": a - b, "mul": a * b, "and": a & b, "or": a | b, "xor": a ^ b,
        "div": a // b if b else -1, "mod": a % b if b else a, "sdiv": quotient if b else (1 if s < 0 else -1), "srem": rest if b else a, "smod": s % d if b else a,
        "shl": a << b if b < 32 else 0, "shr": a >> b if b < 32 else 0, "sar": s >> min(b, 31), "eq": a == b, "ult": a < b, "ule": a <= b, "slt": s < d, "sle": s <= d,
        "sext": (a & 0xFFFF) - (0x10000 if a & 0x8000 else 0), "low": a & 0xFFFF, "high": a >> 16, "concat": (a & 0xFFFF) << 16 | b & 0xFFFF, "ite": b if a else c,
    }[op] % m


def test_machine_operations(spark):
    values = [0, 1, 2, 3, 7, 31, 32, 33, 40, 0x7FFF, 0x8000, 0xFFFF, 0x10000, 2**31 - 1, 2**31, 2**31 + 1, 0x80000001, 2**32 - 2, 2**32 - 1]
    rows = [(a, b, 5) for a in values for b in values]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", *[scalars.machine_op(n, F.col("a"), F.col("b"), c=F.col("c")).alias(n) for n in tabular_queries.MACHINE]).collect()
    for r in got:
        for n in tabular_queries.MACHINE:
            assert r[n] == bit_vector(n, r["a"], r["b"], r["c"]), (n, r["a"], r["b"])


def test_memory(spark):
    m = F.create_map(F.lit(1).cast("long"), F.lit(2).cast("long"))
    m = scalars.memory_write(scalars.memory_write(m, F.lit(5).cast("long"), F.lit(6).cast("long")), F.lit(1).cast("long"), F.lit(9).cast("long"))
    row = spark.range(1).select(*[scalars.memory_read(m, F.lit(k).cast("long")).alias(f"v{k}") for k in (1, 5, 7)]).first()
    assert tuple(row) == (9, 6, 0)


def test_hashes_of_published_values(spark):
    texts = ["a", "The quick brown fox jumps over the lazy dog", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(scalars.one_at_a_time(F.col("t"))).collect()]
    assert got == [0xCA2E9442, 0x519E91F5, 0, None]

    def verification(hash_, width):
        # hashes of 0, 0 1, 0 1 2, ... with seeds counting down, hashed together
        data = b"".join(hash_(bytes(range(i)), 256 - i).to_bytes(width, "little") for i in range(256))
        return hash_(data, 0) & 0xFFFFFFFF

    assert verification(scalars.murmur2_32, 4) == 0x27864C1E
    assert verification(scalars.murmur2_64, 8) == 0x1F0D3804
    assert verification(scalars.murmur3_32, 4) == 0xB0F57EE3


def test_archive_paths(spark):
    rows = spark.createDataFrame([("/n/lib.a(x.o)",), ("/n/lib.a/x.o",), ("/n/lib.a//x.o",), ("/n/x.o",), ("/n/f(1)",), (None,)], "p string")
    assert [r[0] for r in rows.select(scalars.archive_path(F.col("p"))).collect()] == ["/n/lib.a:x.o", "/n/lib.a:x.o", "/n/lib.a:x.o", "/n/x.o", "/n/f(1)", None]


def test_elf_files_of_one_word_size(spark, tmp_path):
    head = lambda bits, order, kind: b"\x7fELF" + bytes([bits, order, 1]) + bytes(9) + (bytes([kind, 0]) if order == 1 else bytes([0, kind])) + bytes(20)
    for name, data in {"a": head(1, 1, 2), "b": head(1, 1, 3), "c": head(2, 1, 2), "d": head(1, 2, 2), "e": head(1, 1, 1), "f": b"\x7fELF", "g": b"", "h": b"#!/bin/sh " * 9}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r["file_type"] for r in formats.binaries_in(spark, str(tmp_path), 32).collect()}
    assert got == {"a": "ELF 32-bit LSB executable", "b": "ELF 32-bit LSB shared object"}
    assert [r["name"] for r in formats.binaries_in(spark, str(tmp_path), 64).collect()] == ["c"]


def test_gml_file_has_its_frame(spark, tmp_path):
    v = spark.createDataFrame([(1, 'a"b'), (2, None)], "id long, label string")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    formats.write_gml(v, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))).splitlines()
    assert text[:2] == ["graph [", "  directed 1"] and text[-2:] == ["  edge [ source 1 target 2 ]", "]"] and len(text) == 6


def test_markers_are_written_back(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", "old"), (3, "checksum Adler", "old")], "id long, text string, comments string")
    found = formats.marked_texts(rows, "id", "text")
    assert sorted(tuple(r) for r in formats.noted(rows, found, "id", "comments").select("id", "comments").collect()) == [(1, None), (2, "old"), (3, "Adler")]


def test_exact_signatures(spark):
    f = spark.createDataFrame([(1, "aabbccddeeff00001122"), (1, "00"), (2, "aabbccddeeffabcd112233"), (3, "aabbccddeeff000011"), (4, None), (5, "ffbbccddeeff00001122")], "file_id long, code string")
    lines = spark.createDataFrame([("AABBCCDDEEFF....1122 00 0000 0010 :0000 f",), ("nothing",), ("AABB 00 0000 0010 :0000 f",)], "value string")
    got = {r["file_id"]: r["is_diff"] for r in formats.exact_by_signature(f, formats.signatures(lines), 4).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert {r["is_diff"] for r in formats.exact_by_signature(f, formats.signatures(lines.limit(0)), 4).collect()} == {1}


def test_operation_codes_are_injective(spark):
    ops = spark.createDataFrame([(["b", "a"],), (["c"],), ([],), (None,)], "ops array<string>")
    code = tabular_queries.operation_codes(ops)
    assert [r[0] for r in ops.where("size(ops) > 0").select(scalars.opcode_hex(F.transform("ops", lambda o: code[o]))).collect()] == ["00020001", "0003"]
    assert ops.limit(0).select(tabular_queries.operation_codes(ops.limit(0))).count() == 0


def test_results_and_modes(spark):
    at = "timestamp '2011-01-01 00:00:00'"
    rows = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, None), (4, 0.0), (5, -9.0)], "file_id long, score double")
    done = results.result_rows(rows, 7, F.expr(at), F.expr(at + " + interval 1500 milliseconds"))
    assert {r["file_id"]: (r["status"], r["elapsed_ms"]) for r in done.collect()} == {
        1: ("OK", 1500), 2: ("TIMEOUT_DATABASE", 1500), 3: ("DATABASE_MISSING", 1500), 4: ("OK", 1500), 5: ("ERROR", 1500)
    }
    assert results.result_rows(rows, 7, F.expr(at)).where("finished_at > timestamp '2020-01-01'").count() == 5
    files = spark.createDataFrame([(i,) for i in range(1, 8)], "file_id long")
    twice = done.unionByName(done.where("file_id = 4").withColumn("score", F.lit(-3.0))).unionByName(done.where("file_id = 1").withColumn("file_id", F.lit(7).cast("long")).withColumn("finished_at", F.lit(None).cast("timestamp")))
    ids = lambda mode: sorted(r[0] for r in results.to_do(files, twice, mode).collect())
    assert ids("replace") == list(range(1, 8)) and ids("resume") == [6] and ids("repair") == [2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        results.to_do(files, done, "other")
    new = done.where("file_id = 2").withColumn("score", F.lit(0.25)).withColumn("finished_at", F.expr(at + " + interval 1 day"))
    assert {r["file_id"]: r["score"] for r in results.merged(done, new).collect()} == {1: 0.5, 2: 0.25, 3: -4.0, 4: 0.0, 5: -9.0}
    log = spark.createDataFrame([(1, "start", "2011-01-01 00:00:00"), (1, "stop", "2011-01-01 00:00:02"), (2, "start", "2011-01-01 00:00:00")], "expt_id long, event string, at string")
    assert {r["expt_id"]: r["elapsed_ms"] for r in results.runs(log.withColumn("at", F.to_timestamp("at"))).collect()} == {1: 2000, 2: None}


def test_work_is_stopped_after_its_time(spark):
    assert results.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = F.udf(lambda x: __import__("time").sleep(0.5) or x, "long")
    with pytest.raises(TimeoutError):
        results.within(spark, 2, lambda: spark.range(0, 400, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).collect())
    assert spark.range(5).count() == 5


def test_matrices(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-2, 3, (5, 5)), rng.integers(-2, 3, (5, 5))
    frame = lambda x: spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in np.argwhere(x)], "src long, dst long, value long")
    cells = lambda df, c="value": {(r["src"], r["dst"]): r[c] for r in df.collect() if r[c]}
    want = lambda x: {(int(i), int(j)): x[i, j] for i, j in np.argwhere(x)}
    assert cells(graph.matrix_product(frame(a), frame(b))) == want(a @ b) and cells(graph.transposed(frame(a))) == want(a.T)
    parts = graph.split_parts(frame(a))
    assert cells(parts, "symmetric") == want((a + a.T) / 2) and cells(parts, "skew") == want((a - a.T) / 2)


def test_preorder(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 9)], "func_id long")
    e = spark.createDataFrame([(1, 2, 2), (1, 3, 1), (3, 4, 1), (2, 4, 1), (4, 3, 1), (5, 5, 1), (6, 7, 1), (7, 6, 1), (4, 8, 2)], "fn_parent long, fn_child long, place int")
    rows = sorted((r["path"], r["func_id"]) for r in graph.preorder(v, e).collect())
    assert [i for _, i in rows] == [1, 3, 4, 8, 2, 5]  # 6 and 7 only call each other


def test_pair_sets(spark):
    pairs = spark.createDataFrame([(1, 2, "IS"), (1, 3, "MAY")], "func1_id long, func2_id long, kind string")
    more = spark.createDataFrame([(1, 2, "MAY"), (4, 4, "MAY"), (4, 4, "MAY")], pairs.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(matching.inserted(pairs, more)) == [(1, 2, "IS"), (1, 3, "MAY"), (4, 4, "MAY")]
    assert rows(matching.deleted(pairs, more)) == [(1, 3, "MAY")]
    assert rows(matching.having(more.distinct(), pairs)) == [(1, 2, "IS"), (4, 4, None)]


def test_path_outputs(spark):
    b = [(1, 1, 0, ["R_EAX:reg32_t = 0x1:reg32_t;", "cjmp(x, name(pc_0x2), 1);"]), (2, 1, 1, ["mem[0x1:reg32_t]:reg32_t = R_EAX:reg32_t;"]), (3, 1, 2, ["label pc_0x2:", "R_EBX:reg32_t = 0x1:reg32_t;", "R_EBX:reg32_t = 0x2:reg32_t;"])]
    blocks = spark.createDataFrame(b, "bb_id long, func_id long, bb_no int, stmts array<string>")
    rows = sorted(tuple(r)[2:] for r in equivalence.path_outputs(graph.control_flow(blocks), blocks).collect())
    assert rows == [(2, 1, 2, 0), (3, 1, 2, 1)]
