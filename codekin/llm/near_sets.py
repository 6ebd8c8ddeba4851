"""Records whose token sets are alike, by a count-vector R-tree.

Tokens are hashed into groups; a record's point is the vector of its group counts. For two records
the overlap of their sets is at most the summed coordinate minima of their points, and for a node
of the tree at most the minima against the node's upper corner. Counts are kept in unary code in
machine words, so that a corner is the bit-wise OR of its points and a summed minimum one AND and a
population count: the whole search runs as joins inside generated code. What exceeds the unary
code's width is carried as a sum, whose minimum is added to the bound, so the bound always holds.

The tree, from the top:

- Subtrees by token. Two sets that are alike share one of the first n - ceil(t n) + 1 tokens of each
  in any common order, so a record stands in one subtree per such token, rare tokens first (a bounded
  list of frequent tokens, found by a sketch, is moved to the end of the order; any list is valid, it
  only decides sizes). A subtree of more than ``hot`` records is divided by the next shared token,
  which lies among one token more of each set, and so on: its size so depends on how many records
  share several rare tokens, not on the collection.
- Subtrees by size. A set's partners have its own size class or the next.
- Nodes. The points of a subtree, in the order of their min-hashes, are packed into leaves of
  ``LEAF`` points, and nodes of ``FAN`` leaves or nodes, each with its corner and range of sizes. A
  record enters at the root and goes down to the nodes that its bound cannot exclude, then meets the
  points of the leaves left. Where a subtree is one leaf, a record visits the corner of the points
  before it, in the order of sizes. No pair is formed in any other way.

Surviving pairs are verified on the whole sets. Exact copies are represented by one record throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekin.plans.scratch import written

GROUPS, BITS = 64, 4  # coordinates of a point, and unary bits of each
WORDS = GROUPS * BITS // 64
LEAF, FAN = 128, 16  # points of a leaf, and children of a node
HOT = 4096  # a subtree of more records is divided
ROUTES = 4  # by at most so many tokens
SPLIT = 4096  # records of one class that a task pairs with others
FREQUENT = 5000  # at most so many frequent tokens are moved to the end of the order
_V = [f"v{i}" for i in range(WORDS)]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def count_points(sets: np.ndarray, tokens: np.ndarray, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Unary-coded group counts of each set (n_sets x WORDS) and what exceeds the code's width."""
    group = (mixed(tokens, 1) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(sets * GROUPS + group, minlength=n_sets * GROUPS).reshape(n_sets, GROUPS)
    kept = np.minimum(counts, BITS)
    unary = (np.uint64(1) << kept.astype(np.uint64)) - np.uint64(1)
    per_word = 64 // BITS
    shifts = (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    words = np.bitwise_or.reduce(unary.reshape(n_sets, WORDS, per_word) << shifts, axis=2)
    return words, (counts - kept).sum(axis=1)


def _points(threshold: float, frequent: np.ndarray, routes: int):
    order_of = np.argsort(frequent)
    ordered = frequent[order_of]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, lists = batch.column(0), batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sets = np.repeat(np.arange(len(n)), n)
            words, over = count_points(sets, tokens, len(n))
            rank = np.zeros(len(tokens), np.int64)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, tokens), len(ordered) - 1)
                known = ordered[at] == tokens
                rank[known] = len(ordered) - order_of[at[known]]  # the most frequent comes last
            starts = np.cumsum(n) - n
            marks = [np.minimum.reduceat(mixed(tokens, seed), starts).view(np.int64) for seed in (2, 3)]
            place = np.lexsort((tokens, rank, sets))
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            kept = np.minimum(prefix + routes - 1, n)
            first = np.arange(len(tokens)) - np.repeat(starts, n) < np.repeat(kept, n)
            keys = tokens[place][first].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            size_class = np.floor(np.log(n) / -np.log(threshold) + 1e-9) if threshold < 1 else n
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array(prefix, pa.int32()),
                    pa.array(size_class.astype(np.int32)), *[pa.array(m) for m in marks], pa.array(over, pa.int64()),
                    *[pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS)],
                ],
                ["rep", "n", "keys", "prefix", "cls", "m1", "m2", "over", *_V],
            )

    return batches


def classes(sets: DataFrame, id_col: str, tokens_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rep, tokens) of each distinct set of at least ``least`` tokens, and (id, rep) of each record.

    ``tokens_col`` is a sorted list of distinct 64-bit token hashes; ids are not null and unique."""
    keyed = sets.where(F.size(tokens_col) >= least).select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(tokens_col).alias("k1"),
        F.xxhash64(F.lit(7), F.size(tokens_col), tokens_col).alias("k2"),
        F.col(tokens_col).alias("tokens"),
    )
    keyed = written(keyed, "sets")
    reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    members = written(keyed.select("id", "k1", "k2").join(reps, ["k1", "k2"]).select("id", "rep"), "members")
    distinct = keyed.join(members.where("id = rep").select("id"), "id", "left_semi")
    return distinct.select(F.col("id").alias("rep"), "tokens"), members


def _bound(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Summed coordinate minima of two points or corners."""
    total = F.least(a["over"], b["over"])
    for v in _V:
        total = total + F.bit_count(a[v].bitwiseAND(b[v]))
    return total


def _subtrees(points: DataFrame, threshold: float, routes: int, hot: int) -> tuple[DataFrame, int]:
    """(key, c, rep): the subtrees of each point and their sizes, and the largest size. Left out are
    records without any other of a size that fits in the subtree. A subtree of more than ``hot``
    records is divided by a further token, up to ``routes``."""
    routed = points.select("rep", "n", "prefix", F.posexplode("keys").alias("place", "key")).where("place < prefix").drop("prefix")
    done, most = [], 0
    by_size = Window.partitionBy("key").orderBy("n")
    t, slack = F.lit(threshold), F.lit(1e-9)
    fits = (F.lag("n").over(by_size) + slack >= t * F.col("n")) | (F.col("n") + slack >= t * F.lead("n").over(by_size))
    for route in range(1, routes + 1):
        counts = written(routed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
        largest = counts.agg(F.max("c")).first()[0] or 0
        counted = routed.join(counts, "key")
        some = counted.where(F.col("c") <= hot)
        done.append(some.withColumn("fits", fits).where("fits").select("key", "c", "rep"))
        if largest <= hot:
            return reduce(DataFrame.unionByName, done), max(most, largest)
        large = counted.where(F.col("c") > hot)
        if route == routes:
            done.append(large.select("key", "c", "rep"))
            return reduce(DataFrame.unionByName, done), largest
        most = hot
        later = points.select("rep", "prefix", F.posexplode("keys").alias("next", "token")).where(F.col("next") < F.col("prefix") + route).drop("prefix")
        routed = large.join(later, "rep").where("next > place").select("rep", "n", F.col("next").alias("place"), F.xxhash64("key", "token").alias("key"))
    raise AssertionError("not reached")


def candidates(points: DataFrame, threshold: float, routes: int, hot: int) -> DataFrame:
    """(a, b), a < b: the pairs of points that the tree does not exclude, once each."""
    share = threshold / (1 + threshold)
    t, slack = F.lit(threshold), F.lit(1e-9)
    point = ["rep", "n", "over", *_V]
    rows, most = _subtrees(points, threshold, routes, hot)

    def side(name: str) -> dict[str, Column]:
        return {x: F.col(f"{name}.{x}") for x in ("over", *_V)}

    def corner(over: Window | None = None, suffix: str = "") -> list[Column]:
        """Range of sizes and upper corner of points."""
        parts = [("least", F.min("n")), ("most", F.max("n")), ("over", F.max("over")), *[(v, F.bit_or(v)) for v in _V]]
        return [(c if over is None else c.over(over)).alias(name + suffix) for name, c in parts]

    def allowed(p: dict[str, Column], n: Column, c: dict[str, Column], least: Column, largest: Column) -> Column:
        """Whether the bound of a point against a corner lets a partner lie below it."""
        return (largest + slack >= t * n) & (n + slack >= t * least) & (_bound(p, c) + slack >= F.lit(share) * (n + F.greatest(least, F.ceil(t * n - slack))))

    alike = (
        (F.least("p.n", "q.n") + slack >= t * F.greatest("p.n", "q.n"))
        & (_bound(side("p"), side("q")) + slack >= F.lit(share) * (F.col("p.n") + F.col("q.n")))
    )
    pair = [F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")]

    # a subtree of one leaf: a point visits the corner of those before it, then these points
    small = rows.where(F.col("c") <= LEAF).select("key", "rep").join(points.select(*point), "rep")
    before = Window.partitionBy("key").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, -1)
    p = small.select("key", *point, *corner(before, "_before"))
    of = {x: F.col(f"{x}_before") for x in ("over", *_V)}
    p = p.where(allowed({x: F.col(x) for x in of}, F.col("n"), of, F.col("least_before"), F.col("most_before"))).select("key", *point).alias("p")
    first = (F.col("q.n") < F.col("p.n")) | ((F.col("q.n") == F.col("p.n")) & (F.col("q.rep") < F.col("p.rep")))
    near = p.join(small.alias("q"), (F.col("p.key") == F.col("q.key")) & first & alike).select(*pair)
    if most <= LEAF:
        return near.distinct()

    members = rows.where(F.col("c") > LEAF).select("key", "rep").join(points.select(*point, "cls", "m1", "m2"), "rep")
    sizes = members.groupBy("key", "cls").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("parts")).where("parts > 1")
    # a subtree that stays large has several roots, so that no task packs more than about ``hot`` points
    parts = F.coalesce("parts", F.lit(1))
    members = members.join(sizes, ["key", "cls"], "left").withColumn("part", F.pmod(F.xxhash64("m1", "m2"), parts).cast("int"))
    own = Window.partitionBy("key", "cls", "part")
    leaf = F.floor((F.row_number().over(own.orderBy("m1", "m2", "rep")) - 1) / LEAF).cast("int")
    members = members.select("key", "cls", "part", leaf.alias("leaf"), F.count(F.lit(1)).over(own).alias("c"), *point)
    members = written(members, "members")

    def nodes(height: int) -> DataFrame:
        """The nodes of a height: leaves have height 0."""
        node = F.shiftright("leaf", height * (FAN.bit_length() - 1))
        rows = members if not height else members.where(F.col("c") > LEAF * FAN ** (height - 1))
        rows = rows.groupBy("key", "cls", "part", node.alias("node")).agg(*corner())
        return rows.withColumn("parent", F.shiftright("node", FAN.bit_length() - 1))

    place = ["key", "cls", "part"]
    roots = members.groupBy(*place).agg(F.max("c").alias("c"))
    most = roots.agg(F.max("c")).first()[0] or 0
    top = 0
    while LEAF * FAN**top < most:
        top += 1
    # a record visits the roots of its own size class and of the next
    visitor = members.select("key", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"), F.col("cls").alias("own"), *point)
    entering = visitor.join(roots, ["key", "cls"])
    visits = None
    for height in range(top, -1, -1):
        low, high = LEAF * FAN ** (height - 1) if height else 0, LEAF * FAN**height
        here = entering.where((F.col("c") > low) & (F.col("c") <= high)).drop("c").withColumn("node", F.lit(0))
        here = here if visits is None else visits.unionByName(here)
        p, c = here.alias("p"), nodes(height).alias("c")
        open_ = allowed(side("p"), F.col("p.n"), side("c"), F.col("c.least"), F.col("c.most"))
        met = p.join(c, [F.col(f"p.{x}") == F.col(f"c.{x}") for x in place] + [F.col("p.node") == F.col("c.parent"), open_])
        visits = met.select(*[f"p.{x}" for x in place], "c.node", "p.own", *[f"p.{x}" for x in point])
    p, q = visits.alias("p"), members.alias("q")
    once = (F.col("p.own") < F.col("q.cls")) | (F.col("p.rep") < F.col("q.rep"))
    met = p.join(q, [F.col(f"p.{x}") == F.col(f"q.{x}") for x in place] + [F.col("p.node") == F.col("q.leaf"), once, alike])
    return near.unionByName(met.select(*pair)).distinct()


def similar_pairs(distinct: DataFrame, threshold: float, routes: int = ROUTES, hot: int = HOT) -> DataFrame:
    """(a, b, similarity): pairs of ``classes``' representatives, a < b, of Jaccard similarity of
    at least ``threshold``. Every such pair is returned once. ``routes`` and ``hot`` change the way
    through the tree, never the pairs."""
    row = distinct.select(F.explode("tokens").alias("t")).agg(F.expr(f"approx_top_k(t, {FREQUENT}, {8 * FREQUENT})").alias("top")).first()
    smallest = distinct.agg(F.min(F.size("tokens"))).first()[0] or 1
    frequent = np.array([x["item"] for x in row["top"] or [] if x["count"] > 1], np.int64).view(np.uint64)
    # sets that are alike share ceil(t n) tokens at least: no more can divide a subtree
    routes = max(1, min(routes, math.ceil(threshold * smallest - 1e-9)))
    points = written(
        distinct.mapInArrow(
            _points(threshold, frequent, routes),
            "rep long, n int, keys array<long>, prefix int, cls int, m1 long, m2 long, over long, " + ", ".join(f"{v} long" for v in _V),
        ),
        "points",
    )
    t, slack = F.lit(threshold), F.lit(1e-9)
    left = distinct.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = distinct.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    rows = candidates(points, threshold, routes, hot)
    verified = rows.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("ta") + F.size("tb")).alias("s"))
    similarity = F.col("i") / (F.col("s") - F.col("i"))
    return verified.where(similarity + slack >= t).select("a", "b", F.round(similarity, 6).alias("similarity"))


def record_pairs(pairs: DataFrame, members: DataFrame, split: int = SPLIT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ``similar_pairs`` of representatives carried over to all records,
    with the pairs of exact copies. A class of more than ``split`` copies is cut for several tasks,
    against other classes as among its own."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("tasks"), F.count(F.lit(1)).alias("c")).where("c > 1")
    tasks = F.coalesce("tasks", F.lit(1))
    cut = members.join(sizes, "rep", "left").select("rep", "id", "c", tasks.alias("tasks"), F.pmod(F.xxhash64("id"), tasks).cast("int").alias("task"))
    large = sizes.where("tasks > 1").drop("c")
    every = F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task")
    across = pairs.select("a", "b")
    for k in ("a", "b"):
        across = across.join(large.withColumnRenamed("rep", k), k, "left").select(*[c for c in across.columns], every)
        own = cut.select(F.col("rep").alias(k), "task", F.col("id").alias(f"i{k}"))
        across = across.join(own, [k, "task"]).drop("task", k)
    many = cut.where("c > 1")
    one = many.select(F.col("rep").alias("a"), F.col("id").alias("ia"), "task")
    two = many.select(F.col("rep").alias("b"), F.col("id").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("of"))
    copies = one.join(two, (F.col("a") == F.col("b")) & (F.col("task") == F.col("of")) & (F.col("ia") < F.col("ib")))
    return across.select("ia", "ib").union(copies.select("ia", "ib")).select(
        F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")
    )


def function_sets(ir_func: DataFrame, ir_bb: DataFrame) -> DataFrame:
    """(func_id, tokens): the sorted hashes of a lifted function's distinct statements and called names.

    Only functions of ``ir_func`` with an id; the statements of all their rows in ``ir_bb`` count,
    whatever ``blocks`` lists; redelivered rows add nothing new. Null statements, null and blank
    names are left out; names lose the white space around them. Functions without any element have
    an empty list. Kinds are kept apart in the hash.
    """
    none = F.array().cast("array<bigint>")

    def hashes(col: str, kind: str, clean) -> Column:
        return F.coalesce(F.array_compact(F.array_distinct(F.transform(col, lambda x: F.when(clean(x), F.xxhash64(F.lit(kind), x))))), none)

    trimmed = F.transform("calls", lambda x: F.btrim(x, F.lit(" \t\r\n")))
    names = ir_func.select("func_id", trimmed.alias("calls")).select(
        "func_id", hashes("calls", "name", lambda x: x.isNotNull() & (x != "")).alias("h"), F.lit(1).alias("own")
    )
    statements = ir_bb.select("func_id", hashes("stmts", "stmt", lambda x: x.isNotNull()).alias("h"), F.lit(0).alias("own")).where(
        F.size("h") > 0
    )
    rows = names.unionByName(statements).where(F.col("func_id").isNotNull())
    return (
        rows.groupBy("func_id")
        .agg(F.max("own").alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("tokens"))
        .where("own = 1")
        .select("func_id", "tokens")
    )
