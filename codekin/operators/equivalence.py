"""Execution paths and bounded checks of semantic equivalence of lifted functions.

No solver is at hand, so equality is never claimed from samples: two functions are TRUE only if
their paths are equal statement by statement, FALSE or MISMATCH if some path of the first cannot be
matched by any of the second, and UNKNOWN where all samples agree.
"""

from __future__ import annotations

import itertools
import json
import random
import re
import time
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.operators.graph import dominators, loop_heads
from codekin.plans.scratch import written

MOST_VISITS = 4  # of one block on one path
PROBE_DEPTH = 50  # how far an unvisited descendant is looked for
MOST_PATHS = 500
MOST_OUTPUTS = 8
SECONDS = 60.0  # for the paths of two functions
SIDE = 32  # classes of one name that meet as many others in one row
STATUSES = ("FALSE", "TRUE", "MISMATCH", "TIMEOUT", "ERR", "TOO_MANY", "ERR_IR", "ERR_UNK", "UNKNOWN")


def paths(entry: int, successors: dict[int, Sequence[int | None]], most: int = MOST_PATHS) -> tuple[list[list[int]], bool]:
    """The execution paths from ``entry`` to blocks without successors, and whether there are more
    than ``most``.

    A block stands at most ``MOST_VISITS`` times on a path. A successor is entered only if it or a
    descendant within ``PROBE_DEPTH`` steps is not on the path yet; one that is not on it goes first."""
    out: list[list[int]] = []
    visits: dict[int, int] = {}
    path: list[int] = []

    def leads_on(block: int) -> bool:
        front, seen = [block], {block}
        for _ in range(PROBE_DEPTH + 1):
            if any(not visits.get(b) for b in front):
                return True
            front = [c for b in front for c in successors.get(b, ()) if c is not None and c not in seen]
            seen.update(front)
            if not front:
                return False
        return False

    def options(block: int) -> list[int]:
        nexts = list(dict.fromkeys(c for c in successors.get(block, ()) if c is not None and c in successors))
        return sorted(nexts, key=lambda c: bool(visits.get(c)))

    if entry not in successors:
        return [], False
    visits[entry] = 1
    path.append(entry)
    work = [iter(options(entry))]
    if not options(entry):
        return [[entry]], False
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            visits[path.pop()] -= 1
            continue
        if visits.get(step, 0) >= MOST_VISITS or not leads_on(step):
            continue
        visits[step] = visits.get(step, 0) + 1
        path.append(step)
        nexts = options(step)
        if not nexts:
            if len(out) >= most:
                return out, True
            out.append(path[:])
        work.append(iter(nexts))
    return out, False


def output_orders(a: Sequence, b: Sequence) -> tuple[int, ...] | None:
    """An order of ``b`` in which it equals ``a`` place by place, of all permutations of up to eight
    items; None without one."""
    if len(a) != len(b) or len(a) > MOST_OUTPUTS:
        return None
    return next((p for p in itertools.permutations(range(len(b))) if all(a[i] == b[j] for i, j in enumerate(p))), None)


_ASSIGN = re.compile(r"^(mem\[(.+)\]|[A-Za-z_][A-Za-z0-9_]*):reg(\d+)_t = (.+);$")
_MEMORY = re.compile(r"^mem\[(.+)\]:reg\d+_t$")
_CAST = re.compile(r"^cast\((.+):reg\d+_t\)[LHUS]:reg\d+_t$")
_BINARY = re.compile(r"^(\S+:reg\d+_t) (\+|-|\*|&|\||\^|<<|>>|==|<>|<=|<) (\S+:reg\d+_t)$")
_ATOM = re.compile(r"^([A-Za-z_][A-Za-z0-9_]*|0x[0-9a-f]+|\d+):reg(\d+)_t$")


class Machine:
    """Concrete state: registers and memory start as seeded functions of their names."""

    def __init__(self, seed: int):
        self.seed, self.values, self.memory, self.outputs = seed, {}, {}, []

    def initial(self, name: str, bits: int) -> int:
        return random.Random(f"{self.seed}/{name}").getrandbits(32) & ((1 << bits) - 1)

    def evaluate(self, text: str) -> int:
        if m := _BINARY.match(text):
            x, y = self.evaluate(m[1]), self.evaluate(m[3])
            by = min(y, 64)
            return {
                "+": x + y, "-": x - y, "*": x * y, "&": x & y, "|": x | y, "^": x ^ y, "<<": x << by, ">>": x >> by,
                "==": int(x == y), "<>": int(x != y), "<": int(x < y), "<=": int(x <= y),
            }[m[2]] & 0xFFFFFFFF
        if m := _MEMORY.match(text):
            at = self.evaluate(m[1])
            return self.memory.get(at, self.initial(f"mem{at}", 32))
        if m := _CAST.match(text):
            return self.evaluate(m[1] + ":reg32_t")
        if m := _ATOM.match(text):
            bits = int(m[2])
            if m[1][0].isdigit():
                return int(m[1], 0) & ((1 << bits) - 1)
            return self.values.get(m[1], self.initial(m[1], bits))
        raise ValueError(text)

    def run(self, statement: str) -> None:
        if m := _ASSIGN.match(statement):
            value = self.evaluate(m[4]) & ((1 << int(m[3])) - 1)
            if m[2]:
                at = self.evaluate(m[2])
                self.memory[at] = value
                self.outputs.append(("mem", value))
            else:
                self.values[m[1]] = value

    def results(self) -> list[tuple]:
        """Writes to memory in order and final registers without temporaries, by name."""
        registers = [("reg", self.values[k]) for k in sorted(self.values) if k.startswith("R_")]
        return self.outputs + registers


class Paths:
    """A function's paths of statements with what their comparison needs; outputs are run when first asked for."""

    def __init__(self, found: Sequence[Sequence[str]], samples: int = 3):
        self.n, self.samples, self.ran = len(found), samples, []
        self.plain = list(dict.fromkeys(tuple(s for s in p if not s.startswith(("label ", "/*"))) for p in found))
        self.known = set(self.plain)
        self.shapes = {(sum("mem[" in s.split(" = ")[0] for s in p), sum(s.startswith("cjmp(") for s in p)) for p in self.plain}

    def outputs(self, until: float) -> list[tuple | None]:
        """Of each path its outputs; None where a statement cannot be run. ``TimeoutError`` after ``until``;
        what has been run by then is kept for the next call."""
        while len(self.ran) < len(self.plain):
            self.ran.append(self._run(self.plain[len(self.ran)], until))
        return self.ran

    def _run(self, path: Sequence[str], until: float) -> tuple | None:
        """An output is what it is in every sample, so that an order in which two paths' outputs agree is
        the same in all of them; sorted, two paths are equal exactly if there is such an order."""
        samples = []
        try:
            for seed in range(self.samples):
                machine = Machine(seed)
                for k, s in enumerate(path):
                    if not k % 64 and time.monotonic() > until:
                        raise TimeoutError
                    machine.run(s)
                samples.append(machine.results())
        except ValueError:
            return None
        return tuple(sorted((kinds[0][0], tuple(v for _, v in kinds)) for kinds in zip(*samples)))


def status(a: Paths, b: Paths, seconds: float = SECONDS) -> str:
    """The status of two functions; TIMEOUT when their paths have not been run in time."""
    if a.n > MOST_PATHS or b.n > MOST_PATHS:
        return "TOO_MANY"
    if not a.n or not b.n:
        return "ERR"
    if not a.shapes <= b.shapes:
        return "MISMATCH"
    if a.known <= b.known:
        return "TRUE"
    until = time.monotonic() + seconds
    try:
        results, found = set(b.outputs(until)), a.outputs(until)
    except TimeoutError:
        return "TIMEOUT"
    if None in results:
        return "ERR_IR"
    for got in found:
        if got not in results:
            return "ERR_IR" if got is None else "FALSE"
    return "UNKNOWN"


def compare_paths(a: Sequence[Sequence[str]], b: Sequence[Sequence[str]], samples: int = 3) -> str:
    """The status of two functions given as paths of statements."""
    return status(Paths(a, samples), Paths(b, samples))


_MOVE = re.compile(r"^([A-Za-z_]\w*):reg32_t = ([A-Za-z_]\w*):reg32_t(?: ([+-]) 0x([0-9a-f]+):reg32_t)?;$")
_TARGET = re.compile(r"^([A-Za-z_]\w*):reg\d+_t = ")


def register_offsets(statements: Sequence[str]) -> dict[str, tuple[str, int]]:
    """Of each register, the register whose first value it holds and by how much it differs.

    Only moves, additions and subtractions of constants are followed; any other write ends a chain."""
    known: dict[str, tuple[str, int]] = {}
    for s in statements:
        if m := _MOVE.match(s):
            base, offset = known.get(m[2], (m[2], 0))
            step = int(m[4], 16) if m[4] else 0
            offset += -step if m[3] == "-" else step
            if base:
                known[m[1]] = (base, (offset + 2**31) % 2**32 - 2**31)
                continue
        if m := _TARGET.match(s):
            known[m[1]] = ("", 0)
    return {k: v for k, v in known.items() if v[0] and v != (k, 0)}


def block_offsets(blocks: DataFrame) -> DataFrame:
    """(bb_id, register, base, offset) at the end of each block."""

    @F.pandas_udf("array<struct<register string, base string, offset long>>")
    def tracked(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [(k, b, o) for k, (b, o) in sorted(register_offsets(list(s)).items())])

    return blocks.select("bb_id", F.explode(tracked("stmts")).alias("x")).select("bb_id", "x.register", "x.base", "x.offset")


def block_outputs(blocks: DataFrame) -> DataFrame:
    """(bb_id, n_conditions, n_registers, n_stores, n_returns): what a block adds to a path: its path
    conditions, distinct machine registers written, stores to memory, and returns (a last statement
    that is no jump)."""
    count = lambda test: F.size(F.filter("stmts", test))
    registers = F.array_distinct(F.filter(F.transform("stmts", lambda s: F.regexp_extract(s, r"^(R_[A-Z]+):reg\d+_t = ", 1)), lambda r: r != ""))
    last = F.try_element_at("stmts", F.lit(-1))
    return blocks.select(
        "bb_id", count(lambda s: s.startswith("cjmp(")).alias("n_conditions"), F.size(registers).alias("n_registers"),
        count(lambda s: s.startswith("mem[")).alias("n_stores"), F.coalesce(~last.rlike(r"^c?jmp\("), F.lit(True)).cast("int").alias("n_returns"),
    )


def _bodies(flow: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """(func_id, blocks): a function's blocks in order, with their successors; its blocks bound the row."""
    body = flow.join(blocks.select("bb_id", "bb_no", *columns), "bb_id")
    return body.groupBy("func_id").agg(F.array_sort(F.collect_list(F.struct("bb_no", "bb_id", "next1", "next2", *columns))).alias("blocks"))


def _unfolded(blocks) -> tuple[list[list[int]], bool]:
    return paths(blocks[0]["bb_id"], {x["bb_id"]: [x["next1"], x["next2"]] for x in blocks})


def function_paths(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func_id, n_paths, n_longest, complete) of each function's control flow; paths stop at 500."""

    @F.pandas_udf("n_paths int, n_longest int, complete boolean")
    def counted(column: pd.Series) -> pd.DataFrame:
        rows = [(len(found), max(map(len, found), default=0), not more) for found, more in map(_unfolded, column)]
        return pd.DataFrame(rows, columns=["n_paths", "n_longest", "complete"])

    return _bodies(flow, blocks).select("func_id", counted("blocks").alias("p")).select("func_id", "p.n_paths", "p.n_longest", "p.complete")


def path_outputs(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func_id, path_no, n_blocks, n_conditions, n_registers, n_stores) of each execution path: its path
    conditions, the distinct machine registers it writes and its stores to memory."""

    @F.pandas_udf("array<struct<n_blocks int, n_conditions int, n_registers int, n_stores int>>")
    def counted(column: pd.Series) -> pd.Series:
        out = []
        for rows in column:
            of = {}
            for x in rows:
                stmts = list(x["stmts"])
                of[x["bb_id"]] = (
                    sum(s.startswith("cjmp(") for s in stmts), {m[1] for s in stmts if (m := re.match(r"(R_[A-Z]+):reg\d+_t = ", s))}, sum(s.startswith("mem[") for s in stmts)
                )
            out.append([(len(p), sum(of[b][0] for b in p), len(set().union(*[of[b][1] for b in p])), sum(of[b][2] for b in p)) for p in _unfolded(rows)[0]])
        return pd.Series(out)

    rows = _bodies(flow, blocks, "stmts").select("func_id", F.posexplode(counted("blocks")).alias("path_no", "p"))
    return rows.select("func_id", "path_no", "p.n_blocks", "p.n_conditions", "p.n_registers", "p.n_stores")


def function_dominators(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func_id, n_reached, n_depth, n_loops) of each function: blocks reached from the first one,
    depth of its dominator tree, heads of natural loops."""

    @F.pandas_udf("n_reached int, n_depth int, n_loops int")
    def counted(column: pd.Series) -> pd.DataFrame:
        out = []
        for rows in column:
            nexts = {x["bb_id"]: [c for c in (x["next1"], x["next2"]) if c is not None and not pd.isna(c)] for x in rows}
            entry = rows[0]["bb_id"]
            idom = dominators(entry, nexts)
            depth = {entry: 0}
            for b in idom:
                chain = [b]
                while chain[-1] not in depth:
                    chain.append(idom[chain[-1]])
                for c in reversed(chain[:-1]):
                    depth[c] = depth[idom[c]] + 1
            out.append((len(idom) + 1, max(depth.values()), len(loop_heads(entry, nexts))))
        return pd.DataFrame(out, columns=["n_reached", "n_depth", "n_loops"])

    return _bodies(flow, blocks).select("func_id", counted("blocks").alias("p")).select("func_id", "p.n_reached", "p.n_depth", "p.n_loops")


def orders(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``matches``: whether some order of list ``b`` equals list ``a``, which is whether
    they are equal once sorted; lists of more than eight items, and null lists, do not match."""

    same = (F.size(a) <= MOST_OUTPUTS) & (F.array_sort(a) == F.array_sort(b))
    return pairs.withColumn("matches", F.coalesce(same, F.lit(False)))


def name_classes(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(func_id, fn_name, class_id): each function's class among those of its name, called by its smallest function.

    ``names``: func_id, fn_name; ``keys``: func_id and a ``key`` that functions share exactly if they
    agree. As agreeing is an equality, the classes carry every pair of one name on as many rows as functions."""
    rows = written(names.join(keys, "func_id").select("func_id", "fn_name", "key"), "keys")
    first = rows.groupBy("fn_name", "key").agg(F.min("func_id").alias("class_id"))
    return rows.join(first, ["fn_name", "key"]).select("func_id", "fn_name", "class_id")


def function_texts(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func_id, text): a function's blocks as JSON: statements without labels and comments, and the
    places of the successors from 1, 0 for none. Equal texts have equal paths."""
    plain = lambda s: ~(s.startswith("label ") | s.startswith("/*"))
    blocks = blocks.withColumn("stmts", F.filter("stmts", plain))
    ids = F.transform("blocks", lambda b: b["bb_id"])
    place = lambda c: F.coalesce(F.array_position(ids, c), F.lit(0).cast("long"))
    rows = F.transform("blocks", lambda b: F.struct(b["stmts"].alias("s"), place(b["next1"]).alias("a"), place(b["next2"]).alias("b")))
    return _bodies(flow, blocks, "stmts").select("func_id", F.to_json(rows).alias("text"))


def text_keys(texts: DataFrame) -> DataFrame:
    return texts.select("func_id", F.sha2("text", 256).alias("key"))


def _text_paths(text: str) -> Paths | None:
    """None for more paths than are followed."""
    blocks = json.loads(text)
    found, more = paths(1, {i: [x["a"] or None, x["b"] or None] for i, x in enumerate(blocks, 1)})
    return None if more else Paths([[s for i in p for s in blocks[i - 1]["s"]] for p in found])


def class_statuses(classes: DataFrame, texts: DataFrame, side: int = SIDE) -> DataFrame:
    """(func1_id, func2_id, status): every ordered pair of classes of one name, by their smallest
    functions, and each class's smallest function with each other member.

    ``classes`` is of ``name_classes`` by ``text_keys``. As members have equal paths, the status of any
    two functions of one name is that of their classes. A name's classes are cut into parts of about
    ``side``; two parts meet in one row, so a hot name is compared in many tasks and each text is
    unfolded once a row, not once a pair."""
    classes = written(classes, "classes")
    heads = classes.groupBy("fn_name", F.col("class_id").alias("func_id")).agg((F.count(F.lit(1)) > 1).alias("many"))
    parts = classes.groupBy("fn_name").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum((F.col("func_id") == F.col("class_id")).cast("long")) / side).alias("parts"))
    heads = heads.join(parts.where("n > 1").drop("n"), "fn_name").join(texts, "func_id")
    part = F.pmod(F.xxhash64("func_id"), F.col("parts"))
    heads = heads.select("fn_name", F.struct("func_id", "many", part.alias("part"), "text").alias("f"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = heads.groupBy("fn_name", F.least("f.part", "other").alias("i"), F.greatest("f.part", "other").alias("j")).agg(F.collect_list("f").alias("fs"))

    def compared(it):
        for pdf in it:
            out = []
            for i, j, fs in zip(pdf.i, pdf.j, pdf.fs):
                known = [(f["func_id"], f["part"], f["many"], _text_paths(f["text"])) for f in fs]
                for f1, p1, many, a in known:
                    for f2, p2, _, b in known:
                        # parts i and j meet here; within one part only in its own row
                        if many and i == j if f1 == f2 else i == j or p1 != p2:
                            out.append((f1, f2, "TOO_MANY" if a is None or b is None else status(a, b)))
            yield pd.DataFrame(out, columns=["func1_id", "func2_id", "status"]).astype({"func1_id": "int64", "func2_id": "int64"})

    rows = written(met.select("i", "j", "fs").mapInPandas(compared, "func1_id long, func2_id long, status string"), "statuses")
    own = rows.where("func1_id = func2_id").select(F.col("func1_id").alias("class_id"), "status")
    members = classes.where("func_id <> class_id").join(own, "class_id").select(F.col("class_id").alias("func1_id"), F.col("func_id").alias("func2_id"), "status")
    return rows.where("func1_id <> func2_id").unionByName(members)
