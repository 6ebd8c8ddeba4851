"""The feature tables of the engine, derived from the tables of a dataset folder.

Functions, call edges, operation sequences, n-gram frequencies and imports in the shapes that the
distance, graph and report operators take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.sources.tables import BLANKS, cleaned, table

#: The operation of a statement: the mnemonic of an assembly comment, else the target or keyword.
OPERATION = r"^(?:/\* )?([A-Za-z]+_?[A-Z]*)"


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function; redelivered rows are one, of each column the value that is not null.

    Names lose the white space around them; blank names are null."""
    rows = table(spark, sf_dir, "func").where("func_id IS NOT NULL")
    rest = [c for c in rows.columns if c != "func_id"]
    return rows.groupBy("func_id").agg(*[F.max(c).alias(c) for c in rest]).withColumn("func_name", cleaned("func_name"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_parent, fn_child), once each, without null ends: G2."""
    return table(spark, sf_dir, "fncalls").where("fn_parent IS NOT NULL AND fn_child IS NOT NULL").select("fn_parent", "fn_child").distinct()


def blocks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(bb_id, func_id, bb_no, stmts): one row per basic block; null statements are an empty list. With ``of`` (func_id)
    only blocks with a row of these functions."""
    rows = table(spark, sf_dir, "ir_bb").where("bb_id IS NOT NULL")
    if of is not None:
        rows = rows.join(rows.join(of, "func_id", "left_semi").select("bb_id"), "bb_id", "left_semi")
    return rows.groupBy("bb_id").agg(
        F.max("func_id").alias("func_id"), F.max("bb_no").alias("bb_no"), F.coalesce(F.max("stmts"), F.array().cast("array<string>")).alias("stmts")
    )


def operation(statement: Column) -> Column:
    return F.regexp_extract(statement, OPERATION, 1)


def operations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(func_id, ops): a function's operations in the order of its blocks (bb_no, bb_id) and statements; of the
    functions in ``of`` (func_id) only, if given.

    One shuffled row per block instead of one per statement."""
    rows = blocks(spark, sf_dir, of).where("func_id IS NOT NULL")
    if of is not None:
        rows = rows.join(of, "func_id", "left_semi")
    rows = rows.select(
        "func_id", F.struct(F.col("bb_no").isNull(), "bb_no", "bb_id", F.transform("stmts", operation).alias("ops")).alias("b")
    )
    ordered = F.array_sort(F.collect_list("b"))
    return rows.groupBy("func_id").agg(F.flatten(F.transform(ordered, lambda b: b["ops"])).alias("ops"))


def ngrams(ops: DataFrame, n: int = 3, keep_tail: bool = False) -> DataFrame:
    """(func_id, ngram): every run of ``n`` consecutive operations, joined by blanks.

    ``keep_tail`` also gives the shorter runs at the last n - 1 positions."""
    last = F.size("ops") - (1 if keep_tail else n)
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return ops.select("func_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("ops", i + 1, F.lit(n)), " "))).alias("ngram"))


def frequencies(spark: SparkSession, sf_dir: str, n: int = 3, of: DataFrame | None = None) -> DataFrame:
    """(func_id, ngram, freq): true counts of each function's n-grams (A6); of the functions in ``of`` only, if given."""
    return ngrams(operations(spark, sf_dir, of), n).groupBy("func_id", "ngram").agg(F.count(F.lit(1)).alias("freq"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(func_id, name), once each: called names that are no anonymous functions."""
    names = table(spark, sf_dir, "ir_func").select("func_id", F.explode("calls").alias("c")).select("func_id", F.btrim("c", F.lit(BLANKS)).alias("name"))
    return names.where("func_id IS NOT NULL AND name <> '' AND NOT lower(name) LIKE 'sub\\\\_%'").distinct()


def lifted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(func_id, fn_name) of the lifted functions with a name; blank and null names are none."""
    names = table(spark, sf_dir, "ir_func").where("func_id IS NOT NULL").groupBy("func_id").agg(F.max(cleaned("fn_name")).alias("fn_name"))
    return names.where("fn_name IS NOT NULL")


def same_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of J12: (func1_id, func2_id, fn_name): every lifted function with the smallest one of its name.

    Each name is represented by one function, so a name that a third of all functions bear makes as
    many pairs as functions, not their square. Relations of the others among themselves do not follow
    from these pairs; ``equivalence.name_classes`` carries them."""
    names = lifted_names(spark, sf_dir)
    first = names.groupBy("fn_name").agg(F.min("func_id").alias("func1_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return names.join(first, "fn_name").where("func_id <> func1_id").select("func1_id", F.col("func_id").alias("func2_id"), "fn_name")


_T = r"e' \t\r\n'"
#: The same tables as SQL, each usable after the ones it names.
VIEWS = {
    "fn": f"""SELECT func_id, max(file_id) AS file_id, nullif(trim(max(func_name), {_T}), '') AS func_name, max(startea) AS startea,
  max(endea) AS endea, max(func_size) AS func_size, max(cyccomp) AS cyccomp, max(num_vars) AS num_vars, max(num_params) AS num_params,
  max(num_ngrams) AS num_ngrams, max(call_level) AS call_level, max(compo) AS compo FROM func WHERE func_id IS NOT NULL GROUP BY func_id""",
    "ce": "SELECT DISTINCT fn_parent, fn_child FROM fncalls WHERE fn_parent IS NOT NULL AND fn_child IS NOT NULL",
    "fe": """SELECT fn_parent, fn_child, a.file_id, a.startea AS pa, b.startea AS ca, a.func_size AS ps, b.func_size AS cs FROM ce
  JOIN fn a ON fn_parent = a.func_id JOIN fn b ON fn_child = b.func_id WHERE a.file_id = b.file_id""",
    "bb": "SELECT bb_id, max(func_id) AS func_id, max(bb_no) AS bb_no, coalesce(max(stmts), []) AS stmts FROM ir_bb WHERE bb_id IS NOT NULL GROUP BY bb_id",
    "st": "SELECT bb_id, func_id, bb_no, unnest(range(0, len(stmts))) AS p, unnest(stmts) AS s FROM bb WHERE func_id IS NOT NULL",
    "op": rf"SELECT func_id, bb_no, bb_id, p, coalesce(regexp_extract(s, '{OPERATION}', 1), '') AS op, row_number() OVER (PARTITION BY func_id ORDER BY bb_no, bb_id, p) AS i FROM st",
    "gr": """SELECT func_id, op || ' ' || o2 || ' ' || o3 AS ngram FROM (SELECT func_id, op, lead(op, 1) OVER w AS o2, lead(op, 2) OVER w AS o3
  FROM op WINDOW w AS (PARTITION BY func_id ORDER BY i)) WHERE o3 IS NOT NULL""",
    "fq": "SELECT func_id, ngram, count(*) AS freq FROM gr GROUP BY 1, 2",
    "sn": f"""SELECT * FROM (SELECT min(func_id) OVER (PARTITION BY fn_name) AS func1_id, func_id AS func2_id, fn_name FROM
  (SELECT func_id, max(nullif(trim(fn_name, {_T}), '')) AS fn_name FROM ir_func WHERE func_id IS NOT NULL GROUP BY 1) WHERE fn_name IS NOT NULL) WHERE func1_id <> func2_id""",
    "im": rf"SELECT DISTINCT func_id, name FROM (SELECT func_id, trim(unnest(calls), {_T}) AS name FROM ir_func) WHERE func_id IS NOT NULL AND name <> '' AND NOT lower(name) LIKE 'sub\_%' ESCAPE '\'",
}


def with_views(select: str, *names: str, **more: str) -> str:
    """``select`` behind the named views and any further ones given by name."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH RECURSIVE " if any("RECURSIVE" in s for s in more.values()) else "WITH ") + ",\n".join(parts) + "\n" + select.strip()
