"""Registered queries on call graphs, control flow, matching and equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.functions.scalars import adjusted_weight, spill_discount
from codekin.operators import distance, equivalence, graph, matching
from codekin.operators.block_vectors import block_rows
from codekin.operators.features import blocks, call_edges, functions, lifted_names, same_name_pairs, with_views
from codekin.operators.gates import COSINE_BELOW, SMALL_FUNCTION, complexity_gate
from codekin.plans.scratch import new_path, written
from codekin.sources import formats
from codekin.sources.tables import table

ADJUST = 1000.0
DIAMETER = 4096
THUNK_SIZE = 5


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(call_edges(spark, sf_dir), functions(spark, sf_dir).select("func_id", "file_id"))


def g02_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges with both ends in one file."""
    return _edges(spark, sf_dir)


def g03_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of recorded calls of each edge, duplicates and self calls included."""
    e = table(spark, sf_dir, "fncalls").where("fn_parent IS NOT NULL AND fn_child IS NOT NULL")
    return e.groupBy("fn_parent", "fn_child").agg(F.count(F.lit(1)).alias("weight"))


def d08_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address distance of each edge, and its adjusted weight."""
    fn = functions(spark, sf_dir).select("func_id", "startea")
    e = _edges(spark, sf_dir).join(fn.select(F.col("func_id").alias("fn_parent"), F.col("startea").alias("a")), "fn_parent")
    e = e.join(fn.select(F.col("func_id").alias("fn_child"), F.col("startea").alias("b")), "fn_child")
    w = F.abs(F.col("a") - F.col("b"))
    return e.select("fn_parent", "fn_child", w.alias("weight"), F.round(adjusted_weight(w, ADJUST), 6).alias("adjusted"))


def g04_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every function in its call graph."""
    return graph.ranks(functions(spark, sf_dir), _edges(spark, sf_dir))


def g05_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak component of every function, named by its smallest function."""
    return graph.components(functions(spark, sf_dir), _edges(spark, sf_dir))


def g05_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function that a function reaches, and by how many calls at least."""
    return graph.reachable(_edges(spark, sf_dir))


def g05_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call level of every function."""
    return graph.call_levels(functions(spark, sf_dir), _edges(spark, sf_dir))


def g06_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function sizes propagated upwards until they no longer change."""
    rows = graph.propagated(functions(spark, sf_dir), _edges(spark, sf_dir), "func_size")
    return rows.select("func_id", F.round(F.col("w") + 1e-9, 6).alias("weight"))


def _spilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = functions(spark, sf_dir).select("func_id", F.lit(1.0).alias("weight"))
    return graph.spill(_edges(spark, sf_dir), sources)


def g07_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight spilled by every function over two hops."""
    return _spilled(spark, sf_dir).select("fn_parent", "fn_child", F.round("weight", 6).alias("weight"), "n_spills")


def g08_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by number of spills."""
    return graph.normalised(_spilled(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _costs(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """file1, file2, func1_id, func2_id, cost of the subject's functions and all they may match, and ``more``
    columns of both functions with 1 and 2 behind their names.

    The subject is the one library of an experiment: here the file with the most functions."""
    fn = functions(spark, sf_dir).withColumns(more)
    subject = _subject(spark, sf_dir)
    queries = fn.where(F.col("file_id") == subject)
    pairs = distance.near_pairs(queries, fn, block_rows(spark, sf_dir), COSINE_BELOW, carry=("file_id", "cyccomp", *more))
    rows = pairs.where(complexity_gate(F.col("cyccomp1"), F.col("cyccomp2")))
    rows = rows.select(F.col("file_id1").alias("file1"), F.col("file_id2").alias("file2"), "func1_id", "func2_id", F.col("value").alias("cost"), *[f"{c}{k}" for c in more for k in (1, 2)])
    return written(rows, "costs")


def _subject(spark: SparkSession, sf_dir: str) -> int:
    top = functions(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_id").first()
    return -1 if top is None else top["file_id"]


def g09_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost assignment of the subject's functions to those of each other file."""
    return matching.assigned(_costs(spark, sf_dir))


def g15_umeyama(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral matching score of the subject's call graph and each other file's."""
    e, subject = _edges(spark, sf_dir), _subject(spark, sf_dir)
    one = e.where(F.col("file_id") == subject).groupBy(F.col("file_id").alias("file1")).agg(F.collect_list(F.struct("fn_parent", "fn_child")).alias("e1"))
    return matching.spectral_matches(e, one)


def g17_align_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment scores of the subject and each other file with a candidate, in all three versions."""
    costs, edges = _costs(spark, sf_dir), written(_edges(spark, sf_dir), "edges")
    sizes = written(functions(spark, sf_dir).select("func_id", "file_id", "func_size"), "sizes")
    scores = [matching.align_scores(costs, edges, sizes, v, SMALL_FUNCTION // 3).withColumnRenamed("score", f"score_v{v}") for v in matching.VERSIONS]
    return scores[0].join(scores[1], ["file1", "file2"]).join(scores[2], ["file1", "file2"])


def g19_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each candidate pair its own cost and the mean cost between the two functions' clusters, which are
    address ranges of one size here."""
    rows = matching.cluster_costs(_costs(spark, sf_dir, cluster=F.floor(F.col("startea") / DIAMETER)))
    return rows.select("func1_id", "func2_id", "vertex", F.round(F.col("cluster") + 1e-9, 6).alias("cluster"))


def g18_pair_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the subject's search by kind: IS for assigned ones, MAY for the other candidates."""
    return matching.kinds(_costs(spark, sf_dir))


def g19_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cost of the paired children and parents of each candidate pair."""
    rows = matching.neighbour_costs(_costs(spark, sf_dir), written(_edges(spark, sf_dir), "edges"))
    return rows.select("func1_id", "func2_id", F.round("child", 6).alias("child"), F.round("parent", 6).alias("parent"))


def g20_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-threshold clusters of function addresses."""
    return graph.clustered(functions(spark, sf_dir), DIAMETER)


def g21_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of functions in the candidate mapping."""
    c = _costs(spark, sf_dir).select(F.col("func1_id").alias("fn_parent"), F.col("func2_id").alias("fn_child"))
    c = written(graph.stars(c), "stars")
    return graph.components(c.select(F.col("fn_child").alias("func_id")).distinct(), c)


def g22_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of every block; -1 for none."""
    flow = graph.control_flow(blocks(spark, sf_dir))
    none = F.lit(-1).cast("long")
    return flow.select("func_id", "bb_id", F.coalesce("next1", none).alias("next1"), F.coalesce("next2", none).alias("next2"))


def g25_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges past thunks: tiny functions with a single callee."""
    e = _edges(spark, sf_dir).select("fn_parent", "fn_child")
    small = functions(spark, sf_dir).where(F.col("num_ngrams") <= THUNK_SIZE).select("func_id")
    thunks = e.where("fn_parent <> fn_child").groupBy(F.col("fn_parent").alias("func_id")).agg(F.count(F.lit(1)).alias("n"), F.min("fn_child").alias("target"))
    return graph.patched(e, thunks.where("n = 1").join(small, "func_id", "left_semi").select("func_id", "target"))


def d22_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of two-call ways between functions."""
    return graph.two_step_counts(_edges(spark, sf_dir).select("fn_parent", "fn_child"))


def d22_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric and skew part of the adjacency matrix of calls."""
    a = _edges(spark, sf_dir).select(F.col("fn_parent").alias("src"), F.col("fn_child").alias("dst"), F.lit(1).alias("value"))
    return graph.split_parts(a)


def d09_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's spilled weight, less the more often its caller is a caller."""
    e = _spilled(spark, sf_dir)
    often = e.groupBy("fn_parent").agg(F.count(F.lit(1)).alias("n"))
    return e.join(often, "fn_parent").select("fn_parent", "fn_child", F.round(spill_discount(F.col("n"), F.col("weight")), 6).alias("weight"))


def w03_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of all call graphs in pre-order, children by size: a key that sorts so."""
    return graph.preorder(functions(spark, sf_dir), w03_children(spark, sf_dir))


def g13_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions, registers and stores of every execution path."""
    return equivalence.path_outputs(*_flow(spark, sf_dir))


def a12_graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and edges of each file's call graph."""
    v = functions(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    e = _edges(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return v.join(e, "file_id", "left").select("file_id", "n_vertices", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


def a13_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the address distances of each file's calls."""
    w = d08_edge_weight(spark, sf_dir).select("fn_parent", F.col("weight").cast("double").alias("w"))
    w = w.join(functions(spark, sf_dir).select(F.col("func_id").alias("fn_parent"), "file_id"), "fn_parent")
    return w.groupBy("file_id").agg(F.round(F.var_pop("w") / 1e6, 4).alias("variance"))


def w03_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of each function in ascending size, numbered."""
    from pyspark.sql import Window

    e = _edges(spark, sf_dir).join(functions(spark, sf_dir).select(F.col("func_id").alias("fn_child"), "func_size"), "fn_child")
    place = F.row_number().over(Window.partitionBy("fn_parent").orderBy("func_size", "fn_child"))
    return e.select("fn_parent", "fn_child", "func_size", place.alias("place"))


def j13_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that documents name, and the function of their file that holds each."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit("0x([0-9a-f]{7})"), F.lit(1)))
    points = table(spark, sf_dir, "documents").select("doc_id", "file_id", F.explode(named).alias("a"))
    points = points.select("doc_id", "file_id", F.conv("a", 16, 10).cast("long").alias("address"))
    ranges = functions(spark, sf_dir).select("file_id", "func_id", "startea", "endea")
    return graph.range_join(points, ranges, ["file_id"], "address", "startea", "endea").select("doc_id", "file_id", "address", "func_id")


def s21_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed address offset from caller to callee of every named call."""
    fn = functions(spark, sf_dir).select("func_id", "func_name", "startea")
    e = _edges(spark, sf_dir).join(fn.select(F.col("func_id").alias("fn_parent"), F.col("func_name").alias("caller"), F.col("startea").alias("a")), "fn_parent")
    e = e.join(fn.select(F.col("func_id").alias("fn_child"), F.col("func_name").alias("callee"), F.col("startea").alias("b")), "fn_child")
    return e.where("caller IS NOT NULL AND callee IS NOT NULL").select("file_id", "caller", "callee", (F.col("b") - F.col("a")).alias("distance"))


def _flow(spark: SparkSession, sf_dir: str):
    b = blocks(spark, sf_dir)
    return graph.control_flow(b), b


def g12_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution paths of every lifted function."""
    return equivalence.function_paths(*_flow(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = written(blocks(spark, sf_dir), "blocks")
    return written(equivalence.function_texts(graph.control_flow(b), b), "texts")


def g11_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each lifted function among those of its name: equal blocks and control flow."""
    return equivalence.name_classes(lifted_names(spark, sf_dir), equivalence.text_keys(_texts(spark, sf_dir)))


def g11_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded equivalence of lifted functions of one name: all pairs of classes, in both directions, and
    each class's first function with its other members. The classes are those of ``g11_classes``."""
    texts = _texts(spark, sf_dir)
    return equivalence.class_statuses(equivalence.name_classes(lifted_names(spark, sf_dir), equivalence.text_keys(texts)), texts)


def f17_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that can call themselves."""
    return graph.recursive_functions(_edges(spark, sf_dir))


def _block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.regexp_extract(F.try_element_at("stmts", F.lit(-1)), r"^([a-z]+)\(", 1)
    return blocks(spark, sf_dir).where("func_id IS NOT NULL").groupBy("func_id").agg(F.collect_list(F.coalesce(kind, F.lit("~"))).alias("kinds"))


def g10_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lifted function and the first of its name, and whether their block kinds agree in some order.
    ``g10_classes`` has all pairs of a name."""
    kinds = _block_kinds(spark, sf_dir)
    pairs = same_name_pairs(spark, sf_dir).join(kinds.select(F.col("func_id").alias("func1_id"), F.col("kinds").alias("a")), "func1_id")
    pairs = pairs.join(kinds.select(F.col("func_id").alias("func2_id"), F.col("kinds").alias("b")), "func2_id")
    return equivalence.orders(pairs, "a", "b").select("func1_id", "func2_id", "matches")


def g10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each lifted function: two functions of one name match in some order exactly if they
    are in one class. Lists of more than eight kinds match nothing, so each is a class of its own."""
    few = F.size("kinds") <= equivalence.MOST_OUTPUTS
    key = F.when(few, F.array_join(F.array_sort("kinds"), " ")).otherwise(F.concat(F.lit("#"), F.col("func_id").cast("string")))
    return equivalence.name_classes(lifted_names(spark, sf_dir), _block_kinds(spark, sf_dir).select("func_id", key.alias("key")))


def g13_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path conditions and outputs of every block."""
    return equivalence.block_outputs(blocks(spark, sf_dir))


def g14_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers that hold another one's first value plus a constant, at the end of every block."""
    return equivalence.block_offsets(blocks(spark, sf_dir))


def g23_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominator trees and natural loops of every lifted function."""
    return equivalence.function_dominators(*_flow(spark, sf_dir))


def s13_dot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graphs written as one DOT file set per binary, named by its path's digest: edges read back."""
    names = table(spark, sf_dir, "bin_file").select("file_id", F.sha1(F.encode("file_path", "UTF-8")).alias("graph"))
    rows = _edges(spark, sf_dir).join(names.where("graph IS NOT NULL"), "file_id")
    path = new_path(spark, "graphs")
    formats.write_dot_sets(rows, "fn_parent", "fn_child", "graph", path)
    return formats.read_dot(spark, path, ["graph"]).groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"))


_NAMES = (
    "g02_edges g03_weights d08_edge_weight g04_rank g05_component g05_reach g05_level g06_propagate g07_spill g08_norm g09_assign g15_umeyama "
    "g17_align_score g18_pair_sets g19_neighbours g19_clusters g20_clusters g21_groups g22_cfg g25_patched d22_two_steps d22_parts d09_discount w03_preorder g13_paths a12_graph_size a13_variance w03_children "
    "j13_range s21_offsets g12_paths g11_equiv g11_classes f17_recursive g10_orders g10_classes g13_outputs g14_offsets g23_dominators s13_dot_files"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_V = ("fn", "ce", "fe")
_SUBJECT = "SELECT file_id FROM fn GROUP BY 1 ORDER BY count(*) DESC, file_id LIMIT 1"
_COSTS = {
    "sb": _SUBJECT,
    "sq": "SELECT func_id, sum(freq * freq)::bigint AS s FROM fq GROUP BY 1",
    "dt": "SELECT q.func_id AS f1, a.func_id AS f2, sum(q.freq * a.freq)::bigint AS dot FROM fq q JOIN fn ON fn.func_id = q.func_id JOIN fq a USING (ngram) WHERE fn.file_id = (SELECT * FROM sb) GROUP BY 1, 2",
    "co": """SELECT q.file_id AS file1, a.file_id AS file2, f1, f2, round(1 - dot / (sqrt(x.s) * sqrt(y.s)), 6) AS cost FROM dt JOIN fn q ON q.func_id = f1 JOIN fn a ON a.func_id = f2
  JOIN sq x ON x.func_id = f1 JOIN sq y ON y.func_id = f2 WHERE q.file_id <> a.file_id AND a.num_ngrams <= 3 * q.num_ngrams AND q.num_ngrams <= 3 * a.num_ngrams
  AND round(1 - dot / (sqrt(x.s) * sqrt(y.s)), 6) < 0.4 AND coalesce(q.cyccomp <= a.cyccomp + greatest(2, floor(0.2 * q.cyccomp)), false)""",
}
_SPILL = """SELECT src, fn_parent, fn_child, hop FROM h1 UNION ALL
SELECT DISTINCT s.src, e.fn_parent, e.fn_child, 2 FROM (SELECT src, fn_parent AS v FROM h1 UNION SELECT src, fn_child FROM h1) s JOIN (SELECT fn_parent AS v, * FROM fe UNION SELECT fn_child, * FROM fe) e ON s.v = e.v
ANTI JOIN h1 ON h1.src = s.src AND h1.fn_parent = e.fn_parent AND h1.fn_child = e.fn_child"""
_H1 = "SELECT fn_parent AS src, fn_parent, fn_child, 1 AS hop FROM fe UNION SELECT fn_child, fn_parent, fn_child, 1 FROM fe"
_SPILLED = "SELECT fe.fn_parent, fe.fn_child, coalesce(sum(power(0.5, hop - 1)), 0.0) AS w, count(hop) AS n FROM fe LEFT JOIN hs USING (fn_parent, fn_child) GROUP BY 1, 2"
_CLOSED = "/* RECURSIVE */ SELECT fn_parent AS a, fn_child AS b FROM fe UNION SELECT cl.a, fn_child FROM cl JOIN fe ON cl.b = fn_parent"
ORACLE = {
    "g02_edges": with_views("SELECT fn_parent, fn_child, file_id FROM fe", *_V),
    "g03_weights": "SELECT fn_parent, fn_child, count(*) AS weight FROM fncalls WHERE fn_parent IS NOT NULL AND fn_child IS NOT NULL GROUP BY 1, 2",
    "d08_edge_weight": with_views("SELECT fn_parent, fn_child, abs(pa - ca) AS weight, round(CASE WHEN abs(pa - ca) <= 1000 THEN exp((abs(pa - ca) - 1000) / 1000.0::double) ELSE abs(pa - ca) - 1000.0::double + 1 END, 6) AS adjusted FROM fe", *_V),
    "g04_rank": with_views("""SELECT func_id, (CASE WHEN func_id IN (SELECT fn_child FROM fe WHERE fn_child <> fn_parent) THEN 1
WHEN func_id IN (SELECT fn_parent FROM fe WHERE fn_child <> fn_parent) THEN 2 ELSE 0 END)::int AS rank FROM fn""", *_V),
    "g05_component": with_views("SELECT a AS func_id, min(b) AS component FROM cl GROUP BY 1", *_V,
        un="SELECT fn_parent AS a, fn_child AS b FROM fe UNION SELECT fn_child, fn_parent FROM fe",
        cl="/* RECURSIVE */ SELECT func_id AS a, func_id AS b FROM fn UNION SELECT cl.a, un.b FROM cl JOIN un ON cl.b = un.a"),
    "g05_reach": with_views("SELECT a AS src, b AS dst, hops FROM cl", *_V).replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT a AS src", """, cl(a, b, hops) USING KEY (a, b) AS (
  SELECT fn_parent, fn_child, 1::int FROM fe GROUP BY 1, 2 UNION SELECT cl.a, fn_child, min(hops) + 1 FROM cl JOIN fe ON cl.b = fn_parent
  WHERE NOT EXISTS (SELECT 1 FROM recurring.cl k WHERE k.a = cl.a AND k.b = fn_child) GROUP BY 1, 2)
SELECT a AS src""", 1),
    "g05_level": with_views("SELECT func_id, coalesce(max(level), 0)::int AS level FROM part LEFT JOIN lv ON lv.p = part.p GROUP BY 1", *_V, cl=_CLOSED,
        part="SELECT func_id, least(func_id, coalesce(min(x.b), func_id)) AS p FROM fn LEFT JOIN (SELECT c.a, c.b FROM cl c JOIN cl d ON c.a = d.b AND c.b = d.a) x ON x.a = func_id GROUP BY 1",
        dag="SELECT DISTINCT x.p AS a, y.p AS b FROM fe JOIN part x ON x.func_id = fn_parent JOIN part y ON y.func_id = fn_child WHERE x.p <> y.p",
        lv="/* RECURSIVE */ SELECT a AS p, 0 AS level FROM dag UNION SELECT dag.b, level + 1 FROM lv JOIN dag ON dag.a = lv.p"),
    "g06_propagate": with_views("SELECT func_id, round(w + 1e-9, 6) AS weight FROM r WHERE i = 40", *_V,
        r="""/* RECURSIVE */ SELECT 0 AS i, func_id, func_size::double AS own, func_size::double AS w FROM fn
UNION ALL SELECT i + 1, r.func_id, own, CASE WHEN m IS NULL THEN own ELSE (0.3 * m + 0.7 * own) / 2 END FROM r
LEFT JOIN (SELECT fn_parent, avg(w) AS m FROM fe JOIN r ON func_id = fn_child WHERE fn_parent <> fn_child GROUP BY 1) c ON fn_parent = r.func_id WHERE i < 40"""),
    "g07_spill": with_views("SELECT fn_parent, fn_child, round(w, 6) AS weight, n AS n_spills FROM sp", *_V, h1=_H1, hs=_SPILL, sp=_SPILLED),
    "g08_norm": with_views("SELECT fn_parent, fn_child, CASE WHEN n = 0 THEN 0.0::double ELSE round(w / n, 6) END AS weight FROM sp", *_V, h1=_H1, hs=_SPILL, sp=_SPILLED),
    "g22_cfg": with_views(r"""SELECT b.func_id, b.bb_id, CASE WHEN coalesce(stmts[-1] LIKE 'jmp(%', false) THEN -1 ELSE coalesce(following, -1) END AS next1, coalesce(next2, -1) AS next2
FROM (SELECT *, lead(bb_id) OVER (PARTITION BY func_id ORDER BY bb_no, bb_id) AS following, regexp_extract(stmts[-1], '^c?jmp\(.*?name\((pc_0x[0-9a-f]+)\)', 1) AS target FROM bb WHERE func_id IS NOT NULL) b
LEFT JOIN (SELECT func_id, regexp_extract(s, '^label (pc_0x[0-9a-f]+):', 1) AS target, min(bb_id) AS next2 FROM st WHERE s LIKE 'label pc%' GROUP BY 1, 2) l ON l.func_id = b.func_id AND l.target = b.target AND b.target <> ''""", "bb", "st"),
    "g25_patched": with_views("""SELECT DISTINCT fn_parent, coalesce(target, fn_child) AS fn_child FROM fe LEFT JOIN
  (SELECT e.fn_parent AS func_id, min(e.fn_child) AS target FROM fe e JOIN fn ON fn.func_id = e.fn_parent WHERE e.fn_parent <> e.fn_child AND num_ngrams <= 5 GROUP BY 1 HAVING count(*) = 1) t ON t.func_id = fn_child""", *_V),
    "d22_two_steps": with_views("SELECT a.fn_parent AS src, b.fn_child AS dst, count(*) AS value FROM fe a JOIN fe b ON a.fn_child = b.fn_parent GROUP BY 1, 2", *_V),
    "d22_parts": with_views("""SELECT src, dst, (sum(x) + sum(y)) / 2.0::double AS symmetric, (sum(x) - sum(y)) / 2.0::double AS skew FROM (
  SELECT fn_parent AS src, fn_child AS dst, 1 AS x, 0 AS y FROM fe UNION ALL SELECT fn_child, fn_parent, 0, 1 FROM fe) GROUP BY 1, 2""", *_V),
    "d09_discount": with_views("SELECT fn_parent, fn_child, round((10 - least(count(*) OVER (PARTITION BY fn_parent), 10)) / 10.0::double * w, 6) AS weight FROM sp", *_V, h1=_H1, hs=_SPILL, sp=_SPILLED),
    "w03_preorder": with_views("SELECT func_id, path FROM cl", *_V, ch="SELECT fn_parent, fn_child, lpad((row_number() OVER (PARTITION BY fn_parent ORDER BY cs, fn_child))::varchar, 6, '0') AS step FROM fe",
        ed="SELECT * FROM ch WHERE fn_parent <> fn_child").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT func_id, path FROM cl", """, cl(func_id, path) USING KEY (func_id) AS (
  SELECT func_id, lpad(func_id::varchar, 12, '0') FROM fn WHERE func_id NOT IN (SELECT fn_child FROM ed) UNION
  SELECT fn_child, min(path || '/' || step) FROM cl JOIN ed ON fn_parent = cl.func_id WHERE NOT EXISTS (SELECT 1 FROM recurring.cl k WHERE k.func_id = fn_child) GROUP BY 1)
SELECT func_id, path FROM cl"""),
    "a12_graph_size": with_views("SELECT file_id, n_vertices, coalesce(n_edges, 0) AS n_edges FROM (SELECT file_id, count(*) AS n_vertices FROM fn GROUP BY 1) LEFT JOIN (SELECT file_id, count(*) AS n_edges FROM fe GROUP BY 1) USING (file_id)", *_V),
    "a13_variance": with_views("SELECT file_id, round(var_pop(abs(pa - ca)::double) / 1e6, 4) AS variance FROM fe GROUP BY 1", *_V),
    "w03_children": with_views("SELECT fn_parent, fn_child, cs AS func_size, row_number() OVER (PARTITION BY fn_parent ORDER BY cs, fn_child)::int AS place FROM fe", *_V),
    "j13_range": with_views("""SELECT DISTINCT doc_id, p.file_id, address, func_id FROM
  (SELECT doc_id, file_id, ('0x' || unnest(regexp_extract_all(text, '0x([0-9a-f]{7})', 1)))::bigint AS address FROM documents) p
JOIN fn ON fn.file_id = p.file_id AND address >= startea AND address < endea""", "fn"),
    "g19_neighbours": with_views("""SELECT co.f1 AS func1_id, co.f2 AS func2_id, round(child, 6) AS child, round(parent, 6) AS parent FROM co
LEFT JOIN (SELECT p1, p2, avg(cc) AS child FROM nb GROUP BY 1, 2) c ON c.p1 = co.f1 AND c.p2 = co.f2 LEFT JOIN (SELECT c1, c2, avg(pc) AS parent FROM nb GROUP BY 1, 2) p ON p.c1 = co.f1 AND p.c2 = co.f2""",
        "fn", "ce", "fe", "bb", "st", "op", "gr", "fq", **_COSTS,
        nb="SELECT p.f1 AS p1, p.f2 AS p2, c.f1 AS c1, c.f2 AS c2, c.cost AS cc, p.cost AS pc FROM co c JOIN fe e1 ON e1.fn_child = c.f1 JOIN fe e2 ON e2.fn_child = c.f2 JOIN co p ON p.f1 = e1.fn_parent AND p.f2 = e2.fn_parent"),
    "g19_clusters": with_views("SELECT f1 AS func1_id, f2 AS func2_id, cost AS vertex, round(avg(cost) OVER (PARTITION BY a.file_id, a.startea // 4096, b.file_id, b.startea // 4096) + 1e-9, 6) AS cluster FROM co JOIN fn a ON a.func_id = f1 JOIN fn b ON b.func_id = f2",
        "fn", "bb", "st", "op", "gr", "fq", **_COSTS),
    "g21_groups": with_views("SELECT a AS func_id, min(b) AS component FROM cl GROUP BY 1", "fn", "bb", "st", "op", "gr", "fq", **_COSTS,
        un="SELECT f1 AS a, f2 AS b FROM co UNION SELECT f2, f1 FROM co",
        cl="/* RECURSIVE */ SELECT a, a AS b FROM un UNION SELECT cl.a, un.b FROM cl JOIN un ON cl.b = un.a"),
    "f17_recursive": with_views("SELECT DISTINCT a AS func_id FROM cl WHERE a = b", *_V,
        cl="/* RECURSIVE */ SELECT fn_parent AS a, fn_child AS b FROM fe UNION SELECT cl.a, fn_child FROM cl JOIN fe ON cl.b = fn_parent"),
    "g10_orders": with_views("SELECT func1_id, func2_id, a.k = b.k AND len(a.k) <= 8 AS matches FROM sn JOIN nk a ON a.func_id = func1_id JOIN nk b ON b.func_id = func2_id", "bb", "sn",
        nk=r"SELECT func_id, list_sort(list(coalesce(regexp_extract(stmts[-1], '^([a-z]+)\(', 1), '~'))) AS k FROM bb WHERE func_id IS NOT NULL GROUP BY 1"),
    "g10_classes": with_views("SELECT func_id, fn_name, CASE WHEN len(k) <= 8 THEN min(func_id) OVER (PARTITION BY fn_name, k) ELSE func_id END AS class_id FROM nk JOIN nm USING (func_id)", "bb",
        nm=r"SELECT func_id, max(nullif(trim(fn_name, e' \t\r\n'), '')) AS fn_name FROM ir_func WHERE func_id IS NOT NULL GROUP BY 1 HAVING max(nullif(trim(fn_name, e' \t\r\n'), '')) IS NOT NULL",
        nk=r"SELECT func_id, list_sort(list(coalesce(regexp_extract(stmts[-1], '^([a-z]+)\(', 1), '~'))) AS k FROM bb WHERE func_id IS NOT NULL GROUP BY 1"),
    "g13_outputs": with_views(r"""SELECT bb_id, len(list_filter(stmts, lambda s: starts_with(s, 'cjmp(')))::int AS n_conditions,
  len(list_distinct(list_filter(list_transform(stmts, lambda s: regexp_extract(s, '^(R_[A-Z]+):reg\d+_t = ', 1)), lambda r: r <> '')))::int AS n_registers,
  len(list_filter(stmts, lambda s: starts_with(s, 'mem[')))::int AS n_stores, coalesce(NOT regexp_matches(stmts[-1], '^c?jmp\('), true)::int AS n_returns FROM bb""", "bb"),
    "s13_dot_files": with_views("SELECT sha1(file_path) AS graph, count(*) AS n_edges FROM fe JOIN bin_file USING (file_id) GROUP BY 1", *_V),
    "s21_offsets": with_views("SELECT fe.file_id, a.func_name AS caller, b.func_name AS callee, ca - pa AS distance FROM fe JOIN fn a ON a.func_id = fn_parent JOIN fn b ON b.func_id = fn_child WHERE a.func_name IS NOT NULL AND b.func_name IS NOT NULL", *_V),
}
