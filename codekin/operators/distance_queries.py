"""Registered queries on distances, gates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.operators import distance, equivalence, gates, near_blocks
from codekin.operators.block_vectors import block_rows
from codekin.operators.features import frequencies, functions, imports, lifted_names, operations, same_name_pairs, with_views
from codekin.operators.skew import heavy_keys, split_join
from codekin.plans.scratch import written
from codekin.sources.tables import table

QUERY_EVERY = 50  # functions whose id is divisible by this are searched for among all


def _base(spark: SparkSession, sf_dir: str):
    fn = functions(spark, sf_dir)
    return fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, written(frequencies(spark, sf_dir), "frequencies")


def _metric(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fn, freq = functions(spark, sf_dir), (block_rows if distance.METRICS[name] is None else frequencies)(spark, sf_dir)
        return distance.distances(name, fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, freq).withColumnRenamed("value", name)

    query.__doc__ = f"Distance '{name}' of every query function and every function of other files."
    return query


def gated_pairs(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = (), more: DataFrame | None = None) -> DataFrame:
    """func1_id, func2_id, cosim, dist: the pairs of the search with the gates P1 to P3 as 0 or 1, their
    complexities and import counts, and columns to carry of functions or of ``more`` (by file_id)."""
    fn = _attributes(spark, sf_dir, functions(spark, sf_dir))
    if more is not None:
        fn = fn.join(more, "file_id")
    queries = fn.where(F.col("func_id") % QUERY_EVERY == 0)
    rows = distance.distances("cosim", queries, fn, block_rows(spark, sf_dir), carry=("c", "i", *carry))
    passes = (
        gates.cosine_gate(F.col("value"))
        & gates.complexity_gate(F.col("c1"), F.col("c2"))
        & gates.import_gate(F.col("i1"), F.col("i2"))
    )
    carried = [f"{c}{k}" for c in carry for k in (1, 2)]
    return rows.select("func1_id", "func2_id", F.col("value").alias("cosim"), passes.cast("int").alias("dist"), "c1", "c2", "i1", "i2", *carried)


def _attributes(spark: SparkSession, sf_dir: str, fn: DataFrame) -> DataFrame:
    """``fn`` with c and i: complexity and number of imports of each function."""
    counts = gates.import_counts(imports(spark, sf_dir))
    return fn.join(counts, "func_id", "left").withColumns({"c": F.col("cyccomp"), "i": F.coalesce("n_imports", F.lit(0)).cast("long")})


def _both(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Pairs with the attributes of both functions, with 1 and 2 behind their names."""
    for k in (1, 2):
        pairs = pairs.join(attributes.select(*[F.col(c).alias(f"func{k}_id" if c == "func_id" else f"{c}{k}") for c in attributes.columns]), f"func{k}_id")
    return pairs


def passing_pairs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """func1_id, func2_id, cosim, c1, c2, i1, i2 and more columns of both functions: the pairs of the
    search that pass the gates P1 to P3, which are tested where the pairs are formed."""
    fn = _attributes(spark, sf_dir, functions(spark, sf_dir))
    rows = distance.near_pairs(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, block_rows(spark, sf_dir), gates.COSINE_BELOW, carry=("c", "i", *more))
    return rows.withColumnRenamed("value", "cosim").where(gates.complexity_gate(F.col("c1"), F.col("c2")) & gates.import_gate(F.col("i1"), F.col("i2")))


def all_passing_pairs(spark: SparkSession, sf_dir: str, carry1: tuple[str, ...] = (), carry2: tuple[str, ...] = (), more: DataFrame | None = None, **search) -> DataFrame:
    """func1_id, func2_id, cosim and columns of either function or of ``more`` (by file_id): of all functions, each against
    all of other files, the pairs that pass the gates P1 to P3."""
    lists = imports(spark, sf_dir).groupBy("func_id").agg(F.collect_list("name").alias("names"))
    n = F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("long")
    fn = functions(spark, sf_dir).join(lists, "func_id", "left").withColumns({"c": F.col("cyccomp"), "i": n})
    if more is not None:
        fn = fn.join(more, "file_id", "left")
    if search.get("names") == "same":
        named = fn.where("func_name IS NOT NULL AND num_ngrams >= 0 AND file_id IS NOT NULL")
        fn = named.join(named.groupBy("func_name").agg(F.count(F.lit(1)).alias("n_named")).where("n_named > 1"), "func_name")
    sought = near_blocks.Search(gates.COSINE_BELOW, distance.RATIO, carry1=carry1, carry2=carry2, **search)
    return distance.near_among(fn, block_rows(spark, sf_dir), sought).withColumnRenamed("value", "cosim")


def f01_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all functions that pass the cosine, complexity and import gates."""
    return all_passing_pairs(spark, sf_dir).select("func1_id", "func2_id", "cosim")


def f04_import_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the search whose first function's imports are among the second's."""
    fn = functions(spark, sf_dir)
    lists = imports(spark, sf_dir).groupBy("func_id").agg(F.collect_list("name").alias("terms"))
    return distance.contained_pairs(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, lists)


def f07_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of interest: no noise names, smaller than 300 bytes."""
    fn = functions(spark, sf_dir).where(gates.not_noise(F.col("func_name")) & gates.is_small(F.col("func_size")))
    return fn.select("func_id", "file_id", "func_name", "func_size")


def f10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: distinct start addresses of large functions, and their sum."""
    big = functions(spark, sf_dir).where(F.col("func_size") > gates.CANDIDATE_SIZE)
    return big.select("file_id", "startea").distinct().groupBy("file_id").agg(F.count("startea").alias("n"), F.sum("startea").alias("sum_startea"))


def f15_prologues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their first instructions and whether they open a stack frame."""
    from codekin.operators.features import blocks

    first = blocks(spark, sf_dir).where("func_id IS NOT NULL").groupBy("func_id").agg(F.min(F.struct("bb_no", "bb_id", "stmts")).alias("b"))
    asm = F.filter(F.transform("b.stmts", lambda s: F.regexp_extract(s, r"^/\* (.*) \*/$", 1)), lambda s: s != "")
    return first.select("func_id", F.slice(asm, 1, 3).alias("first")).select(
        "func_id", F.array_join("first", "; ").alias("opening"), gates.has_prologue(F.col("first")).alias("has_prologue")
    )


def f16_trampolines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a single jump."""
    return operations(spark, sf_dir).where(gates.is_trampoline(F.col("ops"))).select("func_id")


def _output_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codekin.operators.features import blocks

    kinds = blocks(spark, sf_dir).where("func_id IS NOT NULL").select(
        "func_id", F.struct("bb_no", "bb_id", F.regexp_extract(F.try_element_at("stmts", F.lit(-1)), r"^([a-z]+)\(", 1).alias("kind")).alias("b")
    )
    return kinds.groupBy("func_id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["kind"]).alias("kinds"))


def f19_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lifted function and the first one of its name, and whether the kinds of their blocks' last
    statements agree place by place. ``f19_classes`` has all pairs of a name."""
    kinds = _output_kinds(spark, sf_dir)
    pairs = same_name_pairs(spark, sf_dir).join(kinds.select(F.col("func_id").alias("func1_id"), F.col("kinds").alias("a")), "func1_id")
    pairs = pairs.join(kinds.select(F.col("func_id").alias("func2_id"), F.col("kinds").alias("b")), "func2_id")
    return pairs.select("func1_id", "func2_id", "fn_name", gates.outputs_compatible(F.col("a"), F.col("b")).alias("compatible"))


def f19_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each lifted function: two functions of one name are compatible exactly if
    they are in one class."""
    kinds = _output_kinds(spark, sf_dir)
    key = F.array_join(F.transform("kinds", lambda k: F.coalesce(k, F.lit("~"))), " ")
    return equivalence.name_classes(lifted_names(spark, sf_dir), kinds.select("func_id", key.alias("key")))


def f20_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each lifted function: memory statements, and those that are no stack slot."""
    from codekin.operators.features import blocks

    s = blocks(spark, sf_dir).where("func_id IS NOT NULL").select("func_id", F.explode("stmts").alias("s")).where("s LIKE '%mem[%'")
    return s.groupBy("func_id").agg(F.count(F.lit(1)).alias("n_memory"), F.sum((~gates.is_stack_load(F.col("s"))).cast("long")).alias("n_kept"))


def d04_bitap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest edits with which a query function's operations stand in a function of as many operations
    (within the ratio) of another file; -1 beyond a tenth of the text. Whole operations are compared;
    functions without any statement recorded have no row."""
    code = F.array_join(F.transform("ops", lambda o: F.concat(F.coalesce(o, F.lit("")), F.lit(" "))), "")
    ops = operations(spark, sf_dir).select("func_id", code.alias("code"))
    fn = functions(spark, sf_dir)
    fn = written(fn.join(ops, "func_id").select("func_id", "file_id", "num_ngrams", "code"), "codes")
    return distance.edit_pairs(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = table(spark, sf_dir, "ir_func").groupBy("func_id").agg(F.max(F.btrim("fn_name", F.lit(" \t\r\n"))).alias("fn_name"))
    return functions(spark, sf_dir).join(lifted, "func_id").where("func_name IS NOT NULL AND fn_name IS NOT NULL")


def d05_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of a function's two recorded names."""
    return _names(spark, sf_dir).select("func_id", F.levenshtein("func_name", "fn_name").alias("distance"))


def d06_damerau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with transpositions."""
    return _names(spark, sf_dir).select("func_id", distance.text_distance("damerau")("func_name", "fn_name").alias("distance"))


def a01_ngram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency rows of each file."""
    rows = frequencies(spark, sf_dir).join(functions(spark, sf_dir).select("func_id", "file_id"), "func_id")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"))


def a05_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each call between lifted functions: the distinct n-grams of both together."""
    from codekin.operators.features import call_edges

    freq = frequencies(spark, sf_dir).select("func_id", "ngram")
    k = freq.groupBy("func_id").agg(F.count(F.lit(1)).alias("k"))
    edges = call_edges(spark, sf_dir).join(k.select(F.col("func_id").alias("fn_parent"), F.col("k").alias("k1")), "fn_parent")
    edges = edges.join(k.select(F.col("func_id").alias("fn_child"), F.col("k").alias("k2")), "fn_child")
    one = edges.join(freq.select(F.col("func_id").alias("fn_parent"), "ngram"), "fn_parent")
    both = one.join(freq.select(F.col("func_id").alias("fn_child"), "ngram"), ["fn_child", "ngram"]).groupBy("fn_parent", "fn_child").agg(F.count(F.lit(1)).alias("shared"))
    total = F.col("k1") + F.col("k2") - F.coalesce("shared", F.lit(0).cast("long"))
    return edges.join(both, ["fn_parent", "fn_child"], "left").select("fn_parent", "fn_child", total.alias("n_ngrams"))


def u02_only_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of a function that no function of another file has (difference by anti join)."""
    freq = frequencies(spark, sf_dir).join(functions(spark, sf_dir).select("func_id", "file_id"), "func_id")
    elsewhere = freq.groupBy("ngram").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi")).where("lo <> hi").select("ngram")
    return freq.join(elsewhere, "ngram", "left_anti").select("func_id", "ngram", "freq")


def j03_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report: both files, both functions, cosine and gate of each pair of the search."""
    files = table(spark, sf_dir, "bin_file").select("file_id", "file_path")
    rows = gated_pairs(spark, sf_dir, ("file_id", "file_path", "func_name", "cyccomp", "num_ngrams"), files)
    names = {"file_id": "file{}_id", "file_path": "path{}", "func_name": "name{}", "cyccomp": "cyccomp{}", "num_ngrams": "ngrams{}"}
    return rows.select("func1_id", "func2_id", "cosim", "dist", *[F.col(f"{c}{k}").alias(n.format(k)) for c, n in names.items() for k in (1, 2)])


def _report1(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    names = imports(spark, sf_dir).groupBy("func_id").agg(F.collect_set("name").alias("names"))
    rows = rows.join(names.select(F.col("func_id").alias("func1_id"), F.col("names").alias("a")), "func1_id", "left")
    rows = rows.join(names.select(F.col("func_id").alias("func2_id"), F.col("names").alias("b")), "func2_id", "left")
    shared = F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)).cast("long")
    return rows.select(
        F.col("file_id1").alias("file1_id"), "func1_id", F.col("func_name1").alias("name1"), "c1", "i1", F.col("file_id2").alias("file2_id"), "func2_id",
        F.col("func_name2").alias("name2"), "c2", "i2", "cosim", F.when(shared > 0, shared).otherwise(0).alias("numimp"),
    )


def j04_report1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal names that fail a gate, with complexity, import counts and shared imports (J4, J7,
    P11). The search starts from equal names; common names are split."""
    queries, fn, freq = _base(spark, sf_dir)
    named = fn.where("func_name IS NOT NULL AND num_ngrams >= 0").select("func_id", "file_id", "func_name", "num_ngrams")
    heavy, n = heavy_keys(named, F.col("func_name"), distance.HEAVY_SHARE)
    side = lambda df, k: df.select("func_name", *[F.col(c).alias(f"{a}{k}{z}") for c, a, z in (("func_id", "func", "_id"), ("file_id", "f", ""), ("num_ngrams", "n", ""))])
    q = side(named.where(F.col("func_id") % QUERY_EVERY == 0), 1)
    pairs = split_join(q, side(named, 2), "func_name", heavy, "func2_id", max(8, min(4096, n // 200_000)), max(8, min(20_000, n // 200_000)))
    pairs = written(pairs.where((F.col("f1") != F.col("f2")) & distance._within(F.col("n1"), F.col("n2"), distance.RATIO)).select("func1_id", "func2_id"), "named")
    near = distance.near_pairs(queries.join(pairs.select(F.col("func1_id").alias("func_id")).distinct(), "func_id", "left_semi"), fn, freq, 1.0)
    rows = pairs.join(near, ["func1_id", "func2_id"], "left").select("func1_id", "func2_id", F.coalesce("value", F.lit(1.0)).alias("cosim"))
    rows = _both(rows, _attributes(spark, sf_dir, fn).select("func_id", "c", "i", "file_id", "func_name"))
    passes = gates.cosine_gate(F.col("cosim")) & gates.complexity_gate(F.col("c1"), F.col("c2")) & gates.import_gate(F.col("i1"), F.col("i2"))
    return _report1(spark, sf_dir, rows.where(~passes))


def j04_other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all functions of different names that pass the gates, with the same columns."""
    columns = ("file_id", "func_name", "c", "i")
    rows = all_passing_pairs(spark, sf_dir, columns, columns, names="other", shared=True)
    return rows.select(
        F.col("file_id1").alias("file1_id"), "func1_id", F.col("func_name1").alias("name1"), "c1", "i1", F.col("file_id2").alias("file2_id"), "func2_id",
        F.col("func_name2").alias("name2"), "c2", "i2", "cosim", F.col("shared").alias("numimp"),
    )


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pairs are counted without being formed; those that fail are all but those that pass
    fn = functions(spark, sf_dir)
    by_function = distance.pair_counts(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn)
    rows = by_function.groupBy("file_id").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("total"))
    passed = passing_pairs(spark, sf_dir, "file_id").groupBy(F.col("file_id2").alias("file_id")).agg(F.count(F.lit(1)).alias("passed"))
    n = F.col("pairs") - F.coalesce("passed", F.lit(0).cast("long"))
    rows = rows.join(passed, "file_id", "left").withColumn("matches", n).where("matches > 0")
    return rows.join(table(spark, sf_dir, "bin_file").select("file_id", "file_name"), "file_id").select("file_id", "file_name", "matches", "total")


def a03_report2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: gated pairs of one name among all functions, and compared functions. The search starts from equal names."""
    fn = functions(spark, sf_dir)
    total = distance.pair_counts(fn, fn).groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    passed = all_passing_pairs(spark, sf_dir, carry2=("file_id",), names="same").groupBy(F.col("file_id2").alias("file_id")).agg(F.count(F.lit(1)).alias("matches"))
    rows = passed.join(total, "file_id").join(table(spark, sf_dir, "bin_file").select("file_id", "file_name"), "file_id")
    return rows.select("file_id", "file_name", "matches", "total")


def a03_report3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: pairs that fail the gates and compared functions."""
    return _report(spark, sf_dir)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, score): mean over the query functions of the lowest cosine in the file."""
    fn = functions(spark, sf_dir)
    low = distance.lowest_by_file(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, block_rows(spark, sf_dir))
    return low.select("file_id", F.round(F.col("total") / F.col("n") / 1e6, 6).alias("score"))


def t01_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files of the lowest scores, with their paths (T1, J9); ties go to the smaller id."""
    best = _scores(spark, sf_dir).orderBy("score", "file_id").limit(10)
    return best.join(table(spark, sf_dir, "bin_file").select("file_id", "file_path"), "file_id").select("file_id", "file_path", "score")


def a10_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query function: all functions at its lowest cosine."""
    fn = functions(spark, sf_dir)
    return distance.nearest_pairs(fn.where(F.col("func_id") % QUERY_EVERY == 0), fn, block_rows(spark, sf_dir)).withColumnRenamed("value", "cosim")


QUERIES = {
    "d01_cosim": _metric("cosim"), "d02_euclid": _metric("euclid"), "d03_mahal": _metric("mahal"), "d04_bitap": d04_bitap,
    "d05_levenshtein": d05_levenshtein, "d06_damerau": d06_damerau, "f01_gates": f01_gates, "f04_import_subset": f04_import_subset,
    "f07_functions": f07_functions, "f10_candidates": f10_candidates, "f15_prologues": f15_prologues, "f16_trampolines": f16_trampolines,
    "f19_outputs": f19_outputs, "f19_classes": f19_classes, "f20_memory": f20_memory, "a01_ngram_rows": a01_ngram_rows, "a05_union_count": a05_union_count,
    "u02_only_here": u02_only_here, "j03_star": j03_star, "j04_report1": j04_report1, "j04_other_names": j04_other_names, "a03_report2": a03_report2, "a03_report3": a03_report3,
    "t01_topk": t01_topk, "a10_argmin": a10_argmin,
}

_PAIRS = f"""SELECT q.func_id AS func1_id, a.func_id AS func2_id FROM fn q JOIN fn a ON q.file_id <> a.file_id
  AND a.num_ngrams <= {distance.RATIO} * q.num_ngrams AND q.num_ngrams <= {distance.RATIO} * a.num_ngrams
  WHERE q.func_id % {QUERY_EVERY} = 0 AND q.num_ngrams >= 0 AND a.num_ngrams >= 0"""
_ALL_PAIRS = _PAIRS.replace(f"q.func_id % {QUERY_EVERY} = 0 AND ", "")  # every function is searched for
_STATS = "SELECT func_id, count(*) AS k, sum(freq)::bigint AS total, sum(freq * freq)::bigint AS squares FROM fq GROUP BY 1"
_DOT = f"""SELECT q.func_id AS func1_id, a.func_id AS func2_id, sum(q.freq * a.freq)::bigint AS dot FROM fq q JOIN fq a USING (ngram)
  WHERE q.func_id % {QUERY_EVERY} = 0 GROUP BY 1, 2"""
_ALL_DOT = _DOT.replace(f"WHERE q.func_id % {QUERY_EVERY} = 0 ", "")
_COSIM = """SELECT func1_id, func2_id, coalesce(round(1 - dot / (sqrt(s1.squares) * sqrt(s2.squares)), 6), 1.0) AS cosim FROM pr
  LEFT JOIN dt USING (func1_id, func2_id) LEFT JOIN sq s1 ON s1.func_id = func1_id LEFT JOIN sq s2 ON s2.func_id = func2_id"""
_GATED = """SELECT func1_id, func2_id, cosim, (cosim < 0.4 AND coalesce(a.cyccomp <= b.cyccomp + greatest(2, floor(0.2 * a.cyccomp)), false)
  AND coalesce(i1.n, 0) <= coalesce(i2.n, 0))::int AS dist, a.cyccomp AS c1, b.cyccomp AS c2, coalesce(i1.n, 0) AS i1, coalesce(i2.n, 0) AS i2
  FROM cs JOIN fn a ON a.func_id = func1_id JOIN fn b ON b.func_id = func2_id LEFT JOIN ic i1 ON i1.func_id = func1_id LEFT JOIN ic i2 ON i2.func_id = func2_id"""
_IC = "SELECT func_id, count(*) AS n FROM im GROUP BY 1"
_V = ("fn", "bb", "st", "op", "gr", "fq", "im")


def _sql(select: str, *names: str, **more: str) -> str:
    return with_views(select, *(names or _V), **more)


def _cosine_sql(select: str, **more: str) -> str:
    return with_views(select, *_V, **({"pr": _PAIRS, "sq": _STATS, "dt": _DOT, "cs": _COSIM, "ic": _IC, "ga": _GATED} | more))


def _whole_sql(select: str, **more: str) -> str:
    """The same with every function searched for."""
    return _cosine_sql(select, **({"pr": _ALL_PAIRS, "dt": _ALL_DOT} | more))


_REPORT = """SELECT f2.file_id, file_name, count(*) AS matches, any_value(total) AS total FROM ga JOIN fn f1 ON f1.func_id = func1_id JOIN fn f2 ON f2.func_id = func2_id
JOIN (SELECT file_id, count(*) AS total FROM fn WHERE func_id IN (SELECT func2_id FROM ga) GROUP BY 1) t ON t.file_id = f2.file_id
JOIN bin_file b ON b.file_id = f2.file_id WHERE dist = {} {} GROUP BY f2.file_id, file_name"""
_NAMES = "SELECT func_id, max(trim(fn_name, e' \\t\\r\\n')) AS fn_name FROM ir_func GROUP BY 1"
ORACLE = {
    "d01_cosim": _cosine_sql("SELECT * FROM cs"),
    "d02_euclid": _sql(
        """SELECT func1_id, func2_id, round(sqrt((coalesce(s1.squares, 0) + coalesce(s2.squares, 0) - 2 * coalesce(dot, 0))::double), 6) AS euclid FROM pr
LEFT JOIN dt USING (func1_id, func2_id) LEFT JOIN sq s1 ON s1.func_id = func1_id LEFT JOIN sq s2 ON s2.func_id = func2_id""", pr=_PAIRS, sq=_STATS, dt=_DOT),
    "d03_mahal": _sql(
        """SELECT func1_id, func2_id, round(CASE WHEN m1 IS NULL OR m2 IS NULL THEN NULL WHEN abs(v) < 1e-12 AND abs(m1 - m2) < 1e-12 THEN 0
  WHEN abs(v) < 1e-12 THEN 'infinity'::double ELSE sqrt((m1 - m2) * (m1 - m2) / v) END, 6) AS mahal
FROM (SELECT func1_id, func2_id, a.m AS m1, b.m AS m2, (a.k * a.v + b.k * b.v) / (a.k + b.k) AS v FROM pr LEFT JOIN mv a ON a.func_id = func1_id LEFT JOIN mv b ON b.func_id = func2_id)""",
        pr=_PAIRS, mv="SELECT func_id, count(*) AS k, avg(freq) AS m, var_pop(freq) AS v FROM fq GROUP BY 1"),
    "d05_levenshtein": _sql("SELECT func_id, levenshtein(func_name, fn_name)::int AS distance FROM fn JOIN nm USING (func_id) WHERE func_name IS NOT NULL AND fn_name IS NOT NULL", "fn", nm=_NAMES),
    "d06_damerau": _sql("SELECT func_id, damerau_levenshtein(func_name, fn_name)::int AS distance FROM fn JOIN nm USING (func_id) WHERE func_name IS NOT NULL AND fn_name IS NOT NULL", "fn", nm=_NAMES),
    "f01_gates": _whole_sql("SELECT func1_id, func2_id, cosim FROM ga WHERE dist = 1"),
    "f04_import_subset": _sql(
        """SELECT func1_id, func2_id FROM pr LEFT JOIN ic a ON a.func_id = func1_id LEFT JOIN
  (SELECT x.func_id AS x, y.func_id AS y, count(*) AS n_both FROM im x JOIN im y USING (name) WHERE x.func_id % 50 = 0 GROUP BY 1, 2) s ON x = func1_id AND y = func2_id
WHERE coalesce(a.n, 0) = coalesce(n_both, 0)""", "fn", "im", pr=_PAIRS, ic=_IC),
    "f07_functions": _sql("SELECT func_id, file_id, func_name, func_size FROM fn WHERE func_size < 300 AND (func_name IS NULL OR func_name NOT IN ("
        + ", ".join(f"'{n}'" for n in gates.NOISE_NAMES) + "))", "fn"),
    "f10_candidates": _sql("SELECT file_id, count(DISTINCT startea) AS n, sum(DISTINCT startea)::bigint AS sum_startea FROM fn WHERE func_size > 200 GROUP BY 1", "fn"),
    "f15_prologues": _sql(r"""SELECT func_id, array_to_string(f, '; ') AS opening, coalesce(f[1] = 'push %ebp' AND
  (f[2] = 'mov %esp,%ebp' OR (regexp_matches(f[2], '^mov \$0xf{8},%ecx$|^mov \$[0-9][0-9a-fx]*,%eax$') AND f[3] = 'mov %esp,%ebp')), false) AS has_prologue
FROM (SELECT func_id, coalesce(list(x ORDER BY p) FILTER (x <> '')[1:3], []) AS f FROM
  (SELECT b.func_id, p, regexp_extract(s, '^/\* (.*) \*/$', 1) AS x FROM (SELECT func_id, min((bb_no, bb_id)) AS k FROM bb WHERE func_id IS NOT NULL GROUP BY 1) b
   LEFT JOIN st ON st.func_id = b.func_id AND (st.bb_no, st.bb_id) = k) GROUP BY 1)""", "bb", "st"),
    "f16_trampolines": _sql("SELECT func_id FROM op GROUP BY 1 HAVING count(*) = 1 AND max(op) IN ('jmp', 'cjmp')", "bb", "st", "op"),
    "f19_outputs": _sql("SELECT func1_id, func2_id, fn_name, a.k = b.k AS compatible FROM sn JOIN nk a ON a.func_id = func1_id JOIN nk b ON b.func_id = func2_id", "bb", "sn",
        nk=r"SELECT func_id, list(coalesce(regexp_extract(stmts[-1], '^([a-z]+)\(', 1), '~') ORDER BY bb_no, bb_id) AS k FROM bb WHERE func_id IS NOT NULL GROUP BY 1"),
    "f19_classes": _sql("SELECT func_id, fn_name, min(func_id) OVER (PARTITION BY fn_name, k) AS class_id FROM nk JOIN nm USING (func_id)", "bb",
        nm=r"SELECT func_id, max(nullif(trim(fn_name, e' \t\r\n'), '')) AS fn_name FROM ir_func WHERE func_id IS NOT NULL GROUP BY 1 HAVING max(nullif(trim(fn_name, e' \t\r\n'), '')) IS NOT NULL",
        nk=r"SELECT func_id, list(coalesce(regexp_extract(stmts[-1], '^([a-z]+)\(', 1), '~') ORDER BY bb_no, bb_id) AS k FROM bb WHERE func_id IS NOT NULL GROUP BY 1"),
    "f20_memory": _sql(r"SELECT func_id, count(*) AS n_memory, sum((NOT regexp_matches(s, 'mem\[R_ESP(:reg32_t)?( [-+] 0x4:reg32_t)?\]'))::int)::bigint AS n_kept FROM st WHERE contains(s, 'mem[') GROUP BY 1", "bb", "st"),
    "a01_ngram_rows": _sql("SELECT file_id, count(*) AS n_rows FROM fq JOIN fn USING (func_id) GROUP BY 1"),
    "a05_union_count": _sql("SELECT fn_parent, fn_child, count(DISTINCT ngram) AS n_ngrams FROM ce JOIN fq ON func_id IN (fn_parent, fn_child) WHERE fn_parent IN (SELECT func_id FROM fq) AND fn_child IN (SELECT func_id FROM fq) GROUP BY 1, 2", *_V, "ce"),
    "u02_only_here": _sql("SELECT func_id, ngram, freq FROM fq JOIN fn USING (func_id) WHERE ngram NOT IN (SELECT ngram FROM fq JOIN fn USING (func_id) GROUP BY 1 HAVING min(file_id) <> max(file_id))"),
    "j03_star": _cosine_sql("""SELECT func1_id, func2_id, cosim, dist, a.file_id AS file1_id, x.file_path AS path1, a.func_name AS name1, a.cyccomp AS cyccomp1, a.num_ngrams AS ngrams1,
  b.file_id AS file2_id, y.file_path AS path2, b.func_name AS name2, b.cyccomp AS cyccomp2, b.num_ngrams AS ngrams2
FROM ga JOIN fn a ON a.func_id = func1_id JOIN fn b ON b.func_id = func2_id JOIN bin_file x ON x.file_id = a.file_id JOIN bin_file y ON y.file_id = b.file_id"""),
    "j04_report1": _cosine_sql("""SELECT a.file_id AS file1_id, func1_id, a.func_name AS name1, c1, i1, b.file_id AS file2_id, func2_id, b.func_name AS name2, c2, i2, cosim,
  (SELECT count(*) FROM im x JOIN im y USING (name) WHERE x.func_id = func1_id AND y.func_id = func2_id) AS numimp
FROM ga JOIN fn a ON a.func_id = func1_id JOIN fn b ON b.func_id = func2_id WHERE dist = 0 AND a.func_name = b.func_name"""),
    "j04_other_names": _whole_sql("""SELECT a.file_id AS file1_id, func1_id, a.func_name AS name1, c1, i1, b.file_id AS file2_id, func2_id, b.func_name AS name2, c2, i2, cosim,
  (SELECT count(*) FROM im x JOIN im y USING (name) WHERE x.func_id = func1_id AND y.func_id = func2_id) AS numimp
FROM ga JOIN fn a ON a.func_id = func1_id JOIN fn b ON b.func_id = func2_id WHERE dist = 1 AND a.func_name <> b.func_name"""),
    "a03_report2": _whole_sql(_REPORT.format(1, "AND f1.func_name = f2.func_name")),
    "a03_report3": _cosine_sql(_REPORT.format(0, "")),
    "t01_topk": _cosine_sql("""SELECT file_id, file_path, score FROM (SELECT file_id, round(sum(round(low * 1e6)::bigint)::bigint / count(*) / 1e6, 6) AS score FROM
  (SELECT file_id, func1_id, min(cosim) AS low FROM cs JOIN fn ON func_id = func2_id GROUP BY 1, 2) GROUP BY 1 ORDER BY score, file_id LIMIT 10) JOIN bin_file USING (file_id)"""),
    "a10_argmin": _cosine_sql("SELECT func1_id, func2_id, cosim FROM (SELECT *, rank() OVER (PARTITION BY func1_id ORDER BY cosim) AS r FROM cs WHERE cosim < 1) WHERE r = 1"),
}
