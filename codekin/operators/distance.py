"""Distances between functions' n-gram vectors, block by block.

A search takes stated query functions against all functions. Query functions meet all functions of similar
counts in blocks of bounded size (``ratio_pairs``, or ``pair_blocks`` where dot products are needed), and what
is kept of a block's pairs is decided there: pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekin.operators import near_blocks, pair_blocks
from codekin.operators.block_vectors import BlockRows, vectors_with
from codekin.plans.scratch import written

RATIO_KEY = ["__bucket", "__part"]
RATIO = 3  # pairs are dropped when one count is more than so many times the other (P5)
QUERIES_A_BLOCK = 2000  # queries that meet a block of functions in Python
ROWS_A_TASK = 2000  # functions that a task of the ratio join takes
HEAVY_SHARE = 0.005  # names that hold more of all rows are split when they meet
DECIMALS = 6


def vector_stats(freq: DataFrame) -> DataFrame:
    """(func_id, k, total, squares) of each vector: n-grams, sum and sum of squares."""
    f = F.col("freq")
    return freq.groupBy("func_id").agg(F.count(F.lit(1)).alias("k"), F.sum(f).alias("total"), F.sum(f * f).alias("squares"))


def _within(n1: Column, n2: Column, ratio: int) -> Column:
    return (n2 <= ratio * n1) & (n1 <= ratio * n2)


def _ratio_sides(
    queries: DataFrame, functions: DataFrame, ratio: int, carry: Sequence[str], rows_a_task: int, least: int, sizes: DataFrame | None
) -> tuple[DataFrame, DataFrame, int]:
    """Both sides of ``ratio_pairs`` with the columns ``RATIO_KEY`` on which they meet, and the number of cuts."""
    n = F.col("num_ngrams")
    bucket = pair_blocks.bucket_of(n, ratio)
    kept = n >= max(least, 0)
    counts = (functions if sizes is None else sizes).where(kept).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    tasks = {r["b"]: -(-r["c"] // rows_a_task) for r in counts}
    cut = F.create_map(*[F.lit(x) for item in [(-99, 1), *tasks.items()] for x in item])
    q = queries.where(kept).select(
        F.col("func_id").alias("func1_id"), F.col("file_id").alias("__file1"), n.alias("__n1"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket"), *[F.col(c).alias(f"{c}1") for c in carry],
    )
    q = q.withColumn("__parts", F.try_element_at(cut, F.col("__bucket"))).where("__parts > 0")
    q = q.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    a = functions.where(kept).select(
        F.col("func_id").alias("func2_id"), F.col("file_id").alias("__file2"), n.alias("__n2"), bucket.alias("__bucket"),
        F.pmod(F.xxhash64("func_id"), F.coalesce(F.try_element_at(cut, bucket), F.lit(1))).cast("int").alias("__part"), *[F.col(c).alias(f"{c}2") for c in carry],
    )
    return q, a, max(1, min(10_000, sum(tasks.values())))


def ratio_pairs(
    queries: DataFrame, functions: DataFrame, ratio: int = RATIO, other_file: bool = True, carry: Sequence[str] = (),
    rows_a_task: int = ROWS_A_TASK, least: int = 0, sizes: DataFrame | None = None,
) -> DataFrame:
    """(func1_id, func2_id): a query function and each function whose count is within ``ratio``.

    Both have func_id, file_id and num_ngrams. Null counts and those below ``least`` match nothing; 0
    matches 0 only (P6). Counts are put into buckets of powers of ``ratio``; partners lie in the same or
    a neighbouring bucket. A bucket's functions are cut for as many tasks as ``rows_a_task`` asks for,
    and its queries go to each, so every task has about as many functions; ``sizes`` may stand for
    ``functions`` when buckets are counted (a row for each bucket, so at most 45). Columns to ``carry``
    come along from both sides with 1 and 2 behind their names, which saves joining them to the pairs later."""
    q, a, spread = _ratio_sides(queries, functions, ratio, carry, rows_a_task, least, sizes)
    near = _within(F.col("__n1"), F.col("__n2"), ratio)
    if other_file:
        near &= F.col("__file1") != F.col("__file2")
    # what a pair costs is not its bytes: the number of tasks is the number of cuts
    met = q.repartition(spread, *RATIO_KEY).join(a.repartition(spread, *RATIO_KEY), RATIO_KEY)
    return met.where(near).drop(*RATIO_KEY, "__file1", "__file2", "__n1", "__n2")


def vectors(freq: DataFrame) -> DataFrame:
    """(func_id, terms, freqs): each vector as one row. After ``frequencies`` this takes no further shuffle."""
    if "terms" in freq.columns:
        return freq
    rows = freq.groupBy("func_id").agg(F.collect_list(F.struct("ngram", F.col("freq").cast("long").alias("freq"))).alias("v"))
    return rows.select("func_id", F.col("v.ngram").alias("terms"), F.col("v.freq").alias("freqs"))


def _packed(queries: DataFrame | None, functions: DataFrame, freq: DataFrame | BlockRows, carry: Sequence[str], other_file: bool, how: str) -> DataFrame:
    """A written table of the functions with their vectors (``freq``: rows of n-grams or of vectors, or blocks), as ``pair_blocks`` takes it. Functions without a vector
    have an empty one where ``how`` is left. Without ``queries`` no function is marked as one."""
    rows = functions.where("num_ngrams >= 0" + " AND file_id IS NOT NULL" * other_file).select(*dict.fromkeys(("func_id", "file_id", "num_ngrams", *carry)))
    if queries is not None:
        asked = queries.select("func_id").distinct().withColumn("is_query", F.lit(True))
        rows = rows.join(asked, "func_id", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    if isinstance(freq, BlockRows):
        rows = written(vectors_with(rows, freq, how), "packed")
        settled = rows.where("NOT open").drop("open")
        if rows.where("open").isEmpty():
            return settled
        rows, freq = rows.where("open").drop("terms", "freqs", "open"), freq.again(rows.where("open").select("func_id"))
        return settled.unionByName(_filled(rows, freq, how))
    return written(_filled(rows, freq, how), "packed")


def _filled(rows: DataFrame, freq: DataFrame, how: str) -> DataFrame:
    rows = rows.join(vectors(freq).select("func_id", "terms", "freqs"), "func_id", how)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.withColumns({"terms": F.coalesce("terms", empty("string")), "freqs": F.coalesce("freqs", empty("bigint"))})


def near_pairs(
    queries: DataFrame, functions: DataFrame, freq: DataFrame | BlockRows, below: float, ratio: int = RATIO, other_file: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """(func1_id, func2_id, value) of the pairs whose cosine distance is less than ``below`` (1 at most),
    with counts within ``ratio``, and the columns of functions to ``carry`` from both sides."""
    rows = _packed(queries, functions, freq, carry, other_file, "inner")
    return pair_blocks.pairs(rows, pair_blocks.nearer(below, ratio, other_file), ratio, carry)


def near_among(functions: DataFrame, freq: DataFrame | BlockRows, search: near_blocks.Search) -> DataFrame:
    """The pairs of ``near_blocks.near`` among all functions; those of one name are sought from equal names, and functions have
    ``n_named`` then."""
    named = search.names == "same"
    rows = _packed(None, functions, freq, (*search.columns(), *(["n_named"] if named else [])), True, "inner")
    return (near_blocks.near_of_a_name if named else near_blocks.near)(rows, search)


def nearest_pairs(queries: DataFrame, functions: DataFrame, freq: DataFrame | BlockRows, ratio: int = RATIO) -> DataFrame:
    """(func1_id, func2_id, value) of each query's pairs at its lowest cosine distance, if below 1.

    Each block keeps its own lowest only, so few more rows than the result has are ever written."""
    rows = _packed(queries, functions, freq, (), True, "inner")
    near = written(pair_blocks.pairs(rows, pair_blocks.nearest(ratio, True), ratio), "nearest")
    low = near.groupBy("func1_id").agg(F.min("value").alias("value"))
    return near.join(low, ["func1_id", "value"]).select("func1_id", "func2_id", "value")


def lowest_by_file(queries: DataFrame, functions: DataFrame, freq: DataFrame | BlockRows, ratio: int = RATIO) -> DataFrame:
    """(file_id, total, n) of each file: over the queries with a pair in it, the sum of the lowest cosine distances in
    millionths, and their number."""
    return pair_blocks.lowest(_packed(queries, functions, freq, (), True, "left"), ratio)


def contained_pairs(queries: DataFrame, functions: DataFrame, sets: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(func1_id, func2_id) of the pairs of ``ratio_pairs`` whose query's set is part of the other's. ``sets``: func_id and
    terms, once each; a function without a row has the empty set."""
    sets = sets.withColumn("freqs", F.transform("terms", lambda _: F.lit(1).cast("long")))
    return pair_blocks.pairs(_packed(queries, functions, sets, (), True, "left"), pair_blocks.contained(ratio, True), ratio, valued=False)


def pair_counts(queries: DataFrame, functions: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(file_id, func_id, n): of each function the number of query functions of other files within the ratio, if any.

    Counted, not formed: functions and queries are taken by their count of n-grams, and by file for those of
    the own file, so what is joined grows with the distinct counts."""
    kept = lambda df: df.where("num_ngrams >= 0 AND file_id IS NOT NULL").select("func_id", "file_id", F.col("num_ngrams").alias("n"))
    a, bucket = kept(functions), pair_blocks.bucket_of(F.col("m"), ratio)
    q = kept(queries).groupBy("file_id", F.col("n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    near = _within(F.col("n"), F.col("m"), ratio)
    everywhere = q.groupBy("m").agg(F.sum("c").alias("c")).withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    everywhere = a.select("n").distinct().withColumn("b", pair_blocks.bucket_of(F.col("n"), ratio)).join(everywhere, "b").where(near)
    everywhere = everywhere.groupBy("n").agg(F.sum("c").alias("every"))
    own = a.select("file_id", "n").distinct().join(q, "file_id").where(near).groupBy("file_id", "n").agg(F.sum("c").alias("own"))
    rows = a.join(everywhere, "n").join(own, ["file_id", "n"], "left")
    return rows.select("file_id", "func_id", (F.col("every") - F.coalesce("own", F.lit(0).cast("long"))).alias("n")).where("n > 0")


STATS = ("k", "total", "squares")


def mahalanobis() -> Column:
    """D3: difference of means over the pooled deviation of the stored frequencies.

    0 where means and deviations vanish, infinity where only the deviation does, null where a vector
    is empty."""
    m1, m2 = F.col("total1") / F.col("k1"), F.col("total2") / F.col("k2")
    # k * variance = squares - total^2 / k, in whole numbers over k1 * k2 so that zero is exact
    spread = (F.col("squares1") * F.col("k1") - F.col("total1") * F.col("total1")) * F.col("k2") + (
        F.col("squares2") * F.col("k2") - F.col("total2") * F.col("total2")
    ) * F.col("k1")
    pooled = spread / (F.col("k1") * F.col("k2")).cast("double") / (F.col("k1") + F.col("k2"))
    value = (
        F.when(F.col("k1").isNull() | F.col("k2").isNull(), None)
        .when((spread == 0) & (F.col("total1") * F.col("k2") == F.col("total2") * F.col("k1")), 0.0)
        .when(spread == 0, float("inf"))
        .otherwise(F.sqrt((m1 - m2) * (m1 - m2) / pooled))
    )
    return F.round(value, DECIMALS)


#: Metrics by name: a column over both vectors' ``STATS`` (with 1 and 2 behind their names), or None where the
#: pairs' products are needed, which ``pair_blocks`` forms.
METRICS: dict[str, Callable[[], Column] | None] = {"cosim": None, "euclid": None, "mahal": mahalanobis}


def distances(metric: str, queries: DataFrame, functions: DataFrame, freq: DataFrame | BlockRows, carry: Sequence[str] = ()) -> DataFrame:
    """(func1_id, func2_id, value) of one metric for all pairs that pass the ratio filter, and the
    columns to ``carry`` from both sides."""
    value = METRICS[metric]
    if value is None:
        rows = _packed(queries, functions, freq, carry, True, "left")
        return pair_blocks.pairs(rows, pair_blocks.every_pair(metric, RATIO, True), RATIO, carry)
    stats = written(vector_stats(freq), "stats")
    pairs = ratio_pairs(queries.join(stats, "func_id", "left"), functions.join(stats, "func_id", "left"), carry=(*STATS, *carry), sizes=functions)
    return pairs.select("func1_id", "func2_id", value().alias("value"), *[f"{c}{k}" for c in carry for k in (1, 2)])


def approximate_find(pattern: Sequence[str], text: Sequence[str], share: float = 0.1) -> int:
    """The fewest edits with which ``pattern`` stands somewhere in ``text``, or -1 if they exceed
    ``share`` of the text's length. ``.`` in the pattern matches any one character. Both are strings, or
    lists of words that count as characters."""
    budget = int(share * len(text))
    if not pattern:
        return 0
    if len(pattern) - len(text) > budget:  # so many insertions at least
        return -1
    masks: dict[str, int] = {}
    every = 0
    for i, c in enumerate(pattern):
        if c == ".":
            every |= 1 << i
        else:
            masks[c] = masks.get(c, 0) | 1 << i
    goal = 1 << (len(pattern) - 1)
    # bit-parallel columns: plus and minus hold the vertical differences of the distance column
    plus, minus, score = (1 << len(pattern)) - 1, 0, len(pattern)
    full, best = plus, len(pattern)
    for c in text:
        equal = masks.get(c, 0) | every
        across = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & goal:
            score += 1
        elif down & goal:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(across | up)), up & across
        best = min(best, score)
    return best if best <= budget else -1


def _edit_block(ratio: int, share: float):
    def block(queries: pd.DataFrame, functions: pd.DataFrame) -> pd.DataFrame:
        patterns, texts = ([c.split(" ")[:-1] for c in codes] for codes in (queries.code1, functions.code2))
        place: dict[str, int] = {}
        for words in (*patterns, *texts):
            for w in words:
                place.setdefault(w, len(place))

        def counted(lists: list[list[str]]) -> np.ndarray:
            out = np.zeros((len(lists), len(place)), np.int32)
            for i, words in enumerate(lists):
                np.add.at(out[i], [place[w] for w in words], 1)
            return out

        need, has = counted(patterns), counted(texts)
        if "." in place:
            need[:, place["."]] = 0  # stands for any operation
        budget = (share * np.array([len(t) for t in texts])).astype(int)
        n2, file2, id2 = functions.__n2.to_numpy(), functions.__file2.to_numpy(), functions.func2_id.to_numpy()
        known: dict[tuple[str, str], int] = {}
        parts = []
        for i, (id1, file1, n1) in enumerate(zip(queries.func1_id, queries.__file1, queries.__n1)):
            near = np.flatnonzero((n2 <= ratio * n1) & (n1 <= ratio * n2) & (file2 != file1))
            # an operation that the text has too few of costs an edit each time
            open_ = np.maximum(need[i] - has[near], 0).sum(axis=1) <= budget[near]
            edits = np.full(len(near), -1, np.int32)
            for k in np.flatnonzero(open_):
                pair = queries.code1.iat[i], functions.code2.iat[near[k]]
                if pair not in known:
                    known[pair] = approximate_find(patterns[i], texts[near[k]], share)
                edits[k] = known[pair]
            parts.append(pd.DataFrame({"func1_id": np.full(len(near), id1), "func2_id": id2[near], "bitap": edits}))
        return pd.concat(parts) if parts else pd.DataFrame({"func1_id": [], "func2_id": [], "bitap": []}).astype("int64")

    return block


def edit_pairs(queries: DataFrame, functions: DataFrame, share: float = 0.1, ratio: int = RATIO, rows_a_task: int = 500) -> DataFrame:
    """(func1_id, func2_id, bitap) of the pairs of ``ratio_pairs``: the fewest edits with which the query's
    operations stand in the other function's, -1 beyond ``share`` of these.

    Both have ``code``: operations, each with a blank behind it, not null. Blocks of queries and functions
    of bounded size meet in Python once; most pairs are settled there by counting operations, in vector
    operations, and only ids and results come back."""
    q, a, _ = _ratio_sides(queries, functions, ratio, ("code",), rows_a_task, 0, None)
    cuts = F.lit(max(1, -(-queries.count() // QUERIES_A_BLOCK)))
    q = q.withColumn("__cut", F.pmod(F.xxhash64("func1_id"), cuts).cast("int"))
    a = a.withColumn("__cut", F.explode(F.sequence(F.lit(0), cuts - 1)))
    key = [*RATIO_KEY, "__cut"]
    return q.groupBy(*key).cogroup(a.groupBy(*key)).applyInPandas(_edit_block(ratio, share), "func1_id long, func2_id long, bitap int")


def damerau(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbouring characters, each stretch edited once."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def text_distance(name: str) -> Callable:
    """A pandas UDF of (a, b); null if either is null. Results are kept per distinct pair within a batch."""
    call = {"damerau": damerau}[name]

    @F.pandas_udf("int")
    def distance(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            known: dict[tuple, int | None] = {}
            out = []
            for pair in zip(a, b):
                if pair not in known:
                    known[pair] = None if pair[0] is None or pair[1] is None else call(*pair)
                out.append(known[pair])
            yield pd.Series(out, dtype="Int32")

    return distance
