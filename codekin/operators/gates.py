"""Predicates on functions and on pairs of functions, as columns and filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COSINE_BELOW = 0.4
SMALL_FUNCTION = 300
CANDIDATE_SIZE = 200

#: Names of startup and teardown code: fixed values.
NOISE_NAMES = (
    "frame_dummy", "__do_global_dtors_aux", "__do_global_ctors_aux", "__do_global_dtors", "__do_global_ctors",
    "__i686.get_pc_thunk.bx", "__i686.get_pc_thunk.cx", "__libc_csu_fini", "__libc_csu_init", "_start", "start",
    "_init_array", "_fini_array", "__init_array_start", "__fini_array_start", "__init_array_end", "__fini_array_end", "main",
)
#: Segments without code of interest: fixed values.
NOISE_SEGMENTS = ("_init", "_fini", "_plt")


def cosine_gate(cosim: Column) -> Column:
    """A missing distance is 1; passes below 0.4."""
    return F.coalesce(cosim, F.lit(1.0)) < COSINE_BELOW


def complexity_gate(c1: Column, c2: Column) -> Column:
    """The first is at most the second plus a fifth of itself, 2 at least. Null fails."""
    return F.coalesce(c1 <= c2 + F.greatest(F.lit(2), F.floor(F.lit(0.2) * c1)), F.lit(False))


def import_gate(n1: Column, n2: Column) -> Column:
    """No more imports than the other; a missing count is 0."""
    return F.coalesce(n1, F.lit(0)) <= F.coalesce(n2, F.lit(0))


def passing(c1: np.ndarray, c2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """P2 and P3 of arrays of complexities and import counts; NaN stands for null."""
    return (c1 <= c2 + np.maximum(2, np.floor(0.2 * c1))) & (n1 <= n2)


def import_counts(imports: DataFrame) -> DataFrame:
    """(func_id, n_imports): A2."""
    return imports.groupBy("func_id").agg(F.count(F.lit(1)).alias("n_imports"))


def import_subset(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """The pairs whose first function's imports all are imports of the second.

    Relational division by counts: the shared imports are as many as the first one's. Functions
    without imports are a subset of any. Only pairs given are looked at; each import list is joined to
    the pairs of its function, so a popular import alone makes no rows."""
    n1 = import_counts(imports).select(F.col("func_id").alias("func1_id"), F.col("n_imports").alias("n1"))
    lists = imports.groupBy("func_id").agg(F.collect_set("name").alias("names"))
    a = lists.select(F.col("func_id").alias("func1_id"), F.col("names").alias("a"))
    b = lists.select(F.col("func_id").alias("func2_id"), F.col("names").alias("b"))
    rows = pairs.join(n1, "func1_id", "left").join(a, "func1_id", "left").join(b, "func2_id", "left")
    inside = F.col("n1").isNull() | (F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))) == 0)
    return rows.where(inside).select("func1_id", "func2_id")


def not_noise(name: Column, segment: Column | None = None) -> Column:
    """Neither a startup name nor in a noise segment; a null name is no noise."""
    keep = F.coalesce(~name.isin(*NOISE_NAMES), F.lit(True))
    return keep if segment is None else keep & F.coalesce(~segment.isin(*NOISE_SEGMENTS), F.lit(True))


def is_small(size: Column) -> Column:
    """P9."""
    return size < SMALL_FUNCTION


def has_prologue(instructions: Column) -> Column:
    """The list of instructions starts with one of the three accepted stack frame openings."""
    i = [F.lower(F.regexp_replace(F.try_element_at(instructions, F.lit(k)), r"[\s%$]+", " ")) for k in (1, 2, 3)]
    frame = r"^mov (esp, ?ebp|ebp, ?esp)$"
    between = i[1].rlike(r"^mov (ecx, ?0?(x)?f{8}h?|0xf{8}, ?ecx)$") | i[1].rlike(r"^mov (eax, ?[0-9a-fx]+h?|[0-9][0-9a-fx]*, ?eax)$")
    opens = i[0].rlike(r"^push ebp$") & (i[1].rlike(frame) | (between & i[2].rlike(frame)))
    return F.coalesce(opens, F.lit(False))


def is_trampoline(ops: Column) -> Column:
    """A single operation, which jumps."""
    return F.coalesce((F.size(ops) == 1) & ops[0].isin("jmp", "cjmp"), F.lit(False))


def outputs_compatible(a: Column, b: Column) -> Column:
    """Two lists of output kinds have one length and equal kinds at each place."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x), F.lit(False))


def is_stack_load(statement: Column) -> Column:
    """P20: a statement that loads from or stores to the slot below the stack pointer."""
    return F.coalesce(statement.rlike(r"mem\[R_ESP(:reg32_t)?( [-+] 0x4:reg32_t)?\]"), F.lit(False))


def in_range(address: Column, start: Column, end: Column) -> Column:
    """Half-open."""
    return (address >= start) & (address < end)
