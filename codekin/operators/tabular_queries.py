"""Registered queries on scalars, windows, writes, lookups, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codekin.functions import scalars
from codekin.operators import results, writes
from codekin.operators.distance_queries import _whole_sql, all_passing_pairs
from codekin.operators.features import blocks, functions, imports, ngrams, operations, with_views
from codekin.operators.graph_queries import _edges
from codekin.plans.scratch import new_path, written
from codekin.sources import database, formats
from codekin.sources.tables import cleaned, table
from codekin.streaming import worker

FIRST_ID = 21  # the first 20 ids are reserved for subjects


def s01_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of every file as the matcher loads them."""
    return functions(spark, sf_dir).select("file_id", "func_id", "func_size", "cyccomp", "num_ngrams")


def s03_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of functions below 300 bytes (S3)."""
    small = functions(spark, sf_dir).where("func_size < 300").select("func_id")
    return blocks(spark, sf_dir).join(small, "func_id", "left_semi").select("func_id", "bb_id", "bb_no", F.size("stmts").alias("n_stmts"))


def s06_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function's operations as hexadecimal code, two bytes each."""
    ops = written(operations(spark, sf_dir), "operations")
    code = operation_codes(ops)
    return ops.select("func_id", scalars.opcode_hex(F.transform("ops", lambda o: code[o])).alias("code"))


def operation_codes(ops: DataFrame) -> Column:
    """A map of each operation to a code of its own, 1 for the first in order, and so on. An instruction
    set is small; more than two bytes can tell apart raise."""
    names = [r[0] for r in ops.select(F.explode("ops").alias("o")).distinct().orderBy("o").limit(1 << 16).collect()]
    if len(names) >= 1 << 16:
        raise ValueError("more operations than codes of two bytes")
    return F.create_map(*[F.lit(x) for i, n in enumerate(names or [""], 1) for x in (n, i)])


def s11_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges written as DOT text and read back."""
    path = new_path(spark, "dot")
    formats.write_dot(_edges(spark, sf_dir), "fn_parent", "fn_child", path, ["file_id"])
    rows = formats.read_dot(spark, path, ["file_id"])
    return rows.select(F.col("src").cast("long").alias("fn_parent"), F.col("dst").cast("long").alias("fn_child"), F.col("file_id").cast("long").alias("file_id"))


def s14_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their blocks and code written as XML and read back: blocks of each."""
    path = new_path(spark, "xml")
    block = F.struct("bb_no", F.md5(F.array_join("stmts", "\n")).alias("code"))
    rows = blocks(spark, sf_dir).where("func_id IS NOT NULL").groupBy("func_id").agg(F.array_sort(F.collect_list(block)).alias("block"))
    formats.write_xml(rows, path, "functions", "function")
    back = spark.read.format("xml").option("rowTag", "function").schema("func_id long, block array<struct<bb_no int, code string>>").load(path)
    return back.select("func_id", F.size("block").alias("n_blocks"))


def _csv(separator: str, header: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "csv")
        formats.write_report(functions(spark, sf_dir).select("func_id", "func_name", "func_size"), path, separator, header)
        return spark.read.schema("func_id long, func_name string, func_size long").option("sep", separator).option("header", header).csv(path)

    query.__doc__ = f"Functions written as text separated by {separator!r} and read back."
    return query


def s17_gdl_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every graph file, anonymous names without their numbers."""
    return formats.gdl_nodes(table(spark, sf_dir, "gdl_file"), "gdl_id", "body")


def s17_gdl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every graph file."""
    return formats.gdl_edges(table(spark, sf_dir, "gdl_file"), "gdl_id", "body")


def s17_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph file as compact text."""
    return formats.compact_graphs(table(spark, sf_dir, "gdl_file"), "gdl_id", "body")


def s18_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph with as many edges as there are calls, by degree."""
    n = table(spark, sf_dir, "fncalls").count()
    return formats.random_graph(spark, max(1, n // 3), n).groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))


def s20_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all graph files that hold an edge."""
    return formats.token_lines(table(spark, sf_dir, "gdl_file"), "body", "edge:")


def s22_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text names a marked part."""
    return formats.marked_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ("checksum", "opcodes"))


def s24_gml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All call graphs as GML lines."""
    v = functions(spark, sf_dir).select(F.col("func_id").alias("id"), F.col("func_name").alias("label"))
    e = _edges(spark, sf_dir).select(F.col("fn_parent").alias("src"), F.col("fn_child").alias("dst"))
    return formats.gml_lines(v, e)


def s09_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes and digests of the Parquet files of the folder, by their first bytes."""
    return formats.files_in(spark, sf_dir, "*.parquet", b"PAR1").select("name", "size", "file_sha1", "path_sha1")


def s25_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function openings written as signature lines and read back."""
    code = s06_opcodes(spark, sf_dir).where(F.length("code") >= 16)
    line = F.concat(F.upper(F.substring("code", 1, 12)), F.lit(".... 08 8ED9 "), F.lpad(F.hex(F.least(F.length("code") / 2, F.lit(65535)).cast("long")), 4, "0"), F.lit(" :0000 f"), F.col("func_id").cast("string"))
    path = new_path(spark, "signatures")
    code.select(line.alias("value")).write.text(path)
    rows = formats.signatures(spark.read.text(path))
    return rows.select("pattern", "crc_length", "length", F.regexp_extract(F.col("names")[0], r"f(\d+)$", 1).cast("long").alias("func_id"))


WILD = 4  # digits of a signature that stand for any byte


def e01_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: 0 if one of its functions has an opening that the signatures list, else 1.

    The signatures are lines as pattern files have them, written from the openings of the functions of
    files 1 to 20, whose ids are reserved for subjects: twelve digits, two bytes that may be anything, and
    four digits more. They meet the functions on what they fix, as an equi-join."""
    code = written(s06_opcodes(spark, sf_dir).join(functions(spark, sf_dir).select("func_id", "file_id"), "func_id"), "codes")
    long = F.length("code") >= 20
    line = F.concat(F.upper(F.substring("code", 1, 12)), F.lit("." * WILD), F.upper(F.substring("code", 17, 4)), F.lit(" 00 0000 0010 :0000 opening"))
    path = new_path(spark, "patterns")
    code.where(long & (F.col("file_id") < FIRST_ID)).select(line.alias("value")).distinct().write.text(path)
    return formats.exact_by_signature(code, formats.signatures(spark.read.text(path)), WILD)


def d07_cyccomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision points, exits and cyclomatic complexity of lifted functions."""
    last = F.try_element_at("stmts", F.lit(-1))
    jumps = F.size(F.filter("stmts", lambda s: s.startswith("jmp(") | s.startswith("cjmp(")))
    exits = (~F.coalesce(last.startswith("jmp(") | last.startswith("cjmp("), F.lit(False))).cast("int")
    rows = blocks(spark, sf_dir).where("func_id IS NOT NULL").groupBy("func_id").agg(F.sum(jumps).alias("decisions"), F.sum(exits).alias("exits"))
    return rows.select("func_id", "decisions", "exits", scalars.cyclomatic(F.col("decisions"), F.col("exits")).alias("cyccomp"))


def d11_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of paths and names, and the bitness of files."""
    f = table(spark, sf_dir, "bin_file")
    return f.select("file_id", F.sha1(F.encode("file_path", "UTF-8")).alias("path_sha1"), F.md5(F.encode("file_name", "UTF-8")).alias("name_md5"), F.coalesce(scalars.bitness(F.col("file_type")), F.lit(0)).alias("bits"))


def _function_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(func_id, text): the bytes of each function's statements, in the order of its blocks."""
    rows = blocks(spark, sf_dir).where("func_id IS NOT NULL").groupBy("func_id").agg(F.array_sort(F.collect_list(F.struct("bb_no", "bb_id", "stmts"))).alias("b"))
    return rows.select("func_id", F.encode(F.array_join(F.flatten(F.transform("b", lambda b: b["stmts"])), "\n"), "UTF-8").alias("text"))


def d12_function_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each function's statements."""
    return _function_text(spark, sf_dir).select("func_id", F.md5("text").alias("digest"))


def d12_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each function's statements."""
    return _function_text(spark, sf_dir).select("func_id", F.crc32("text").alias("crc"))


def d14_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further hashes of function names: FNV-1a, one-at-a-time, Murmur2 and 3, CRC-32, xxHash64."""
    n = functions(spark, sf_dir).where("func_name IS NOT NULL").withColumn("m2", scalars.murmur2("func_name"))
    return n.select("func_id", "m2.murmur2", "m2.murmur2_64", scalars.one_at_a_time(F.col("func_name")).alias("one_at_a_time"), scalars.fnv1a(F.col("func_name")).alias("fnv1a"), scalars.murmur3("func_name").alias("murmur3"), F.crc32(F.encode("func_name", "UTF-8")).alias("crc32"), F.xxhash64("func_name").alias("xxhash64"))


def d15_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph titles with control characters and quotes escaped."""
    return table(spark, sf_dir, "gdl_file").where("title IS NOT NULL").select("gdl_id", scalars.escape_controls(F.col("title")).alias("title"))


def d16_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node and rest of each file's path, without double slashes, and the name of a member of an archive
    in its place (D16, D17)."""
    path = scalars.single_slashes(F.col("file_path"))
    member = scalars.archive_path(F.concat(path, F.lit(".a("), F.col("file_name"), F.lit(")")))
    return table(spark, sf_dir, "bin_file").select("file_id", scalars.mount_node(path).alias("node"), scalars.mount_rest(path).alias("rest"), member.alias("member"))


def d18_opcode_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the opcode at the start of each file's digest."""
    return table(spark, sf_dir, "bin_file").select("file_id", F.coalesce(scalars.opcode_length(F.col("file_sha1")), F.lit(0)).alias("n_bytes"))


def d20_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds from a graph file row's sight to its load, for nodes."""
    rows = table(spark, sf_dir, "gdl_node").where("seen_at IS NOT NULL AND loaded_at IS NOT NULL")
    return rows.select("node_id", scalars.elapsed_ms(F.col("seen_at"), F.col("loaded_at")).alias("elapsed_ms"))


MACHINE = (
    "not", "neg", "add", "sub", "mul", "and", "or", "xor", "div", "mod", "sdiv", "srem", "smod", "shl", "shr", "sar", "eq", "ult", "ule", "slt", "sle",
    "sext", "low", "high", "concat", "ite",
)


def d24_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine operations on addresses and sizes of functions, once as they stand (r_) and once with the
    address negated, so that its sign counts (s_); shifts go by the size modulo 40 (D24, D25)."""
    f = functions(spark, sf_dir).where("startea IS NOT NULL AND func_size IS NOT NULL")
    a, b, by = F.col("startea"), F.col("func_size"), F.pmod("func_size", F.lit(40))
    other = lambda n: by if n in ("shl", "shr", "sar") else b
    return f.select(
        "func_id", *[scalars.machine_op(n, a, other(n), c=F.col("endea")).alias(f"r_{n}") for n in MACHINE],
        *[scalars.machine_op(n, -a, other(n), c=F.col("endea")).alias(f"s_{n}") for n in MACHINE],
    )


def d25_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to and reads from a memory: size at the start, complexity at the end, then start again."""
    f = functions(spark, sf_dir).where("startea IS NOT NULL AND endea IS NOT NULL AND func_size IS NOT NULL AND cyccomp IS NOT NULL")
    m = F.create_map(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    for at, value in (("startea", "func_size"), ("endea", "cyccomp"), ("startea", "endea")):
        m = scalars.memory_write(m, F.col(at), F.col(value).cast("long"))
    read = lambda at: scalars.memory_read(m, at)
    return f.select("func_id", read(F.col("startea")).alias("first"), read(F.col("endea")).alias("second"), read(F.col("startea") + 1).alias("third"))


def w01_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of each function's 3-grams."""
    return ngrams(operations(spark, sf_dir), 3).groupBy("func_id", "ngram").agg(F.count(F.lit(1)).alias("freq"))


def w02_first_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each client and content."""
    rows = table(spark, sf_dir, "bin_file").where("file_sha1 IS NOT NULL").select("client_id", "file_sha1", "file_id", "file_path")
    return writes.keep_first(rows, ["client_id", "file_sha1"], "file_id")


def w04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes after all their deliveries: the last write wins."""
    rows = table(spark, sf_dir, "gdl_node").where("loaded_at IS NOT NULL").select("node_id", "title", "color", "loaded_at")
    late = F.col("loaded_at") >= F.lit("2011-12-01").cast("timestamp")
    return writes.upsert(rows.where(~late), rows.where(late), ["node_id"], "loaded_at").select("node_id", F.unix_micros("loaded_at").alias("loaded_us"), F.coalesce("title", F.lit("")).alias("title"))


def w05_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next function of a file starts, else where the file's code ends."""
    fn = functions(spark, sf_dir).where("startea IS NOT NULL")
    w = Window.partitionBy("file_id").orderBy("startea", "func_id")
    end = F.max("endea").over(Window.partitionBy("file_id"))
    return fn.select("file_id", "func_id", F.coalesce(F.lead("startea").over(w), end).alias("boundary"))


def u05_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call targets that are no node titles yet, as they would be added."""
    old = table(spark, sf_dir, "gdl_node").select(cleaned("title").alias("name")).where("name IS NOT NULL")
    new = table(spark, sf_dir, "gdl_edge").select(cleaned("targetname").alias("name")).where("name IS NOT NULL")
    return writes.insert_ignore(old, new, ["name"])


def u06_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the distinct imported names."""
    return writes.dense_ids(imports(spark, sf_dir), "name")


def u08_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the first-copy flag set anew."""
    f = table(spark, sf_dir, "bin_file").select("file_id", "client_id", "file_sha1", "is_first")
    first = writes.keep_first(f.select("client_id", "file_sha1", "file_id"), ["client_id", "file_sha1"], "file_id").select("file_id", F.lit(True).alias("f"))
    rows = f.join(first, "file_id", "left")
    done = writes.updated(rows, F.lit(True), is_first=F.coalesce("f", F.lit(False)))
    return done.select("file_id", "is_first")


def u09_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the distinct file names after the reserved ones."""
    return writes.dense_ids(table(spark, sf_dir, "bin_file").select("file_name"), "file_name", FIRST_ID)


def t04_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory loads of each function by base, then offset (T4, T5)."""
    pattern = r"= mem\[([A-Z_a-z0-9]+):reg32_t \+ 0x([0-9a-f]+):reg32_t\]"
    s = blocks(spark, sf_dir).where("func_id IS NOT NULL").select("func_id", F.explode("stmts").alias("s")).where(F.col("s").rlike(pattern))
    load = F.struct(F.regexp_extract("s", pattern, 1).alias("base"), F.conv(F.regexp_extract("s", pattern, 2), 16, 10).cast("long").alias("offset"))
    rows = s.groupBy("func_id").agg(F.array_sort(F.collect_list(load)).alias("loads"))
    return rows.select("func_id", F.array_join(F.transform("loads", lambda x: F.concat(x["base"], F.lit("+"), x["offset"].cast("string"))), " ").alias("loads"))


def j08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path's digest is that of an earlier listing."""
    f = table(spark, sf_dir, "bin_file")
    listed = f.where("path_sha1 IS NOT NULL").select(F.col("file_id").alias("listed_id"), "path_sha1")
    now = f.select("file_id", F.sha1(F.encode("file_path", "UTF-8")).alias("path_sha1"))
    return now.join(listed, "path_sha1").select("file_id", "listed_id")


def j10_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their part of the largest graph (join with a one-row aggregate)."""
    f = table(spark, sf_dir, "bin_file").where("num_vertices IS NOT NULL")
    return spark.sql("SELECT file_id, round(num_vertices / (SELECT max(num_vertices) FROM {f}), 6) AS part FROM {f}", f=f)


def j11_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each experiment with its subject, a client's first file, and the number of its results.

    Subjects are one a client, so their side is small and left to the planner to broadcast."""
    f = table(spark, sf_dir, "bin_file").select(F.col("client_id").cast("long").alias("expt_id"), "file_id", "file_path")
    subject = writes.keep_first(f.where("expt_id IS NOT NULL"), ["expt_id"], "file_id")
    done = _earlier_results(spark, sf_dir).groupBy("expt_id").agg(F.count(F.lit(1)).alias("n_results"))
    return done.join(subject, "expt_id").select("expt_id", F.col("file_id").alias("subject_id"), F.col("file_path").alias("subject_path"), "n_results")


def j03_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all functions that pass the gates with the result of the compared file, keyed by its experiment.

    A function carries the results of its file into the search, so pairs are not joined."""
    done = _earlier_results(spark, sf_dir).groupBy("file_id").agg(F.collect_list(F.struct("expt_id", "score", "status")).alias("results"))
    pairs = all_passing_pairs(spark, sf_dir, carry2=("file_id", "results"), more=done)
    return pairs.select("func1_id", "func2_id", "cosim", F.col("file_id2").alias("file_id"), F.inline("results2"))


EARLIER = "2011-11-01"  # an earlier run, for the queries on results


def _earlier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of an earlier run: the part of a file's graph files of that time that are complete, its
    client as experiment; no score where none is, no time where it is not known."""
    whole = F.coalesce(F.rtrim("body").endswith("}"), F.lit(False)).cast("long")
    g = table(spark, sf_dir, "gdl_file").where(F.coalesce("written_at", F.lit("1970-01-01").cast("timestamp")) < F.lit(EARLIER).cast("timestamp"))
    g = g.groupBy("file_id").agg(F.sum(whole).alias("w"), F.count(F.lit(1)).alias("n"), F.min("written_at").alias("a"), F.max("written_at").alias("b"))
    g = g.join(table(spark, sf_dir, "bin_file").select("file_id", F.col("client_id").cast("long").alias("e")), "file_id")
    return results.result_rows(g.withColumn("score", F.when(F.col("w") > 0, F.round(F.col("w") / F.col("n"), 6))), F.col("e"), F.col("a"), F.col("b"))


def x04_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of an earlier run with their status."""
    return _earlier_results(spark, sf_dir).select("file_id", "expt_id", "elapsed_ms", F.unix_micros("finished_at").alias("finished_us"), "score", "status")


def x05_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each client a run works on in each mode."""
    files, done = table(spark, sf_dir, "bin_file").select("file_id", "client_id"), _earlier_results(spark, sf_dir)
    parts = [results.to_do(files, done, m).groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "client_id", "n") for m in results.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def x06_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and stop of each experiment's run."""
    rows = _earlier_results(spark, sf_dir).where("finished_at IS NOT NULL")
    started = F.unix_micros("finished_at") - 1000 * F.col("elapsed_ms")
    log = rows.select("expt_id", F.lit("start").alias("event"), F.timestamp_micros(started).alias("at"))
    log = log.unionByName(rows.select("expt_id", F.lit("stop").alias("event"), F.col("finished_at").alias("at")))
    return results.runs(log).select("expt_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("stopped_at").alias("stopped_us"), "elapsed_ms")


def w04_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after a second run has repaired what the earlier one left (W4, X5): score 1 for the repaired."""
    done = _earlier_results(spark, sf_dir)
    files = results.to_do(table(spark, sf_dir, "bin_file").select("file_id", F.col("client_id").cast("long").alias("e")), done, "repair")
    at = F.lit("2013-01-01").cast("timestamp")
    new = results.result_rows(files.withColumn("score", F.lit(1.0)), F.col("e"), at, at)
    return results.merged(done, new).select("file_id", "expt_id", "elapsed_ms", "score", "status")


def f12_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a good result of an earlier run, or with a bad one: to be worked on again."""
    return results.to_do(table(spark, sf_dir, "bin_file").select("file_id"), _earlier_results(spark, sf_dir), "repair")


def f13_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without any result of an earlier run."""
    return results.to_do(table(spark, sf_dir, "bin_file").select("file_id"), _earlier_results(spark, sf_dir), "resume")


def a11_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last address of each file's functions and their distance (A11), and total size."""
    rows = functions(spark, sf_dir).groupBy("file_id").agg(F.min("startea").alias("lo"), F.max("endea").alias("hi"), F.sum(F.col("endea") - F.col("startea")).alias("size"))
    return rows.select("file_id", "lo", "hi", (F.col("hi") - F.col("lo")).alias("diameter"), "size")


def a15_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each lifted function."""
    return operations(spark, sf_dir).select("func_id", F.size("ops").alias("n_ops"))


def a18_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: functions with local variables, with parameters, and their sums."""
    has = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).cast("long")
    return functions(spark, sf_dir).groupBy("file_id").agg(has("num_vars").alias("with_vars"), has("num_params").alias("with_params"), F.sum(F.coalesce("num_vars", F.lit(0))).alias("vars"), F.sum(F.coalesce("num_params", F.lit(0))).alias("params"))


_SLOT = r"mem\[(R_E[BS]P):reg32_t ([+-]) 0x([0-9a-f]+):reg32_t\]"


def a18_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each lifted function: distinct slots of its stack frame below and above the saved registers.

    Slots above them, from eight bytes over the frame pointer on, are parameters; those over the stack
    pointer and below the frame pointer are local variables."""
    found = F.regexp_extract_all("s", F.lit(_SLOT), F.lit(0))
    s = blocks(spark, sf_dir).where("func_id IS NOT NULL").select("func_id", F.explode("stmts").alias("s")).where(F.col("s").contains("mem[R_E"))
    s = s.select("func_id", F.explode(found).alias("m"))
    part = lambda k: F.regexp_extract("m", _SLOT, k)
    slots = s.select("func_id", part(1).alias("base"), part(2).alias("sign"), F.conv(part(3), 16, 10).cast("long").alias("offset")).distinct()
    above = (F.col("base") == "R_EBP") & (F.col("sign") == "+") & (F.col("offset") >= 8)
    local = (F.col("base") == "R_ESP") | (F.col("sign") == "-")
    return slots.groupBy("func_id").agg(F.sum(local.cast("long")).alias("n_vars"), F.sum(above.cast("long")).alias("n_params"))


def s19_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables dumped into another folder, one of them emptied there and restored: rows of each."""
    names, target = ("bin_file", "func", "fncalls"), new_path(spark, "database")
    database.dump(spark, sf_dir, target, names)
    database.truncate(spark, target, "func")
    database.dump(spark, sf_dir, target, ["func"])
    parts = [spark.read.parquet(f"{target}/{n}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def x01_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph files worked off as a stream, batch by batch: nodes and edges of each."""
    return worker.graph_sizes(spark, f"{sf_dir}/gdl_file.parquet", new_path(spark, "stream"))


_NAMES = (
    "s09_files s25_signatures s01_functions s03_small_blocks s06_opcodes s11_dot s14_xml s17_gdl_nodes s17_gdl_edges s17_compact s18_random s20_lines s22_markers s24_gml e01_exact "
    "d07_cyccomp d11_digests d12_function_digest d12_checksum d14_hashes d15_escaped d16_paths d18_opcode_length d20_elapsed d24_machine w01_ngrams w02_first_copy "
    "w04_upsert w05_boundary u05_ignore u06_ids u08_update u09_reserved t04_loads j08_paths j10_scalar j11_lookup f12_pending f13_unseen a11_extent "
    "a15_instructions a18_frames j03_results a18_offsets s19_database x01_worker x04_results x05_modes x06_runs w04_results d25_memory"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()} | {"s15_csv": _csv(",", False), "s16_tsv": _csv("\t", True)}

_GRAPH = ("fn", "ce", "fe")
_CODE = "SELECT func_id, string_agg(lpad(lower(to_hex(k)), 4, '0'), '' ORDER BY i) AS code FROM op JOIN (SELECT op, row_number() OVER (ORDER BY op) AS k FROM (SELECT DISTINCT op FROM op)) USING (op) GROUP BY 1"
_CALLS = "SELECT func_id, func_name, func_size FROM fn"
_NODE, _EDGE = formats._GDL_NODE, formats._GDL_EDGE
_LABEL = "CASE WHEN lower(l) LIKE 'nullsub\\_%' ESCAPE '\\' THEN 'nullsub_' WHEN lower(l) LIKE 'sub\\_%' ESCAPE '\\' THEN 'sub_' ELSE l END"
_GDL_N = f"SELECT gdl_id, t AS title, {_LABEL} AS label FROM (SELECT gdl_id, unnest(regexp_extract_all(body, '{_NODE}', 1)) AS t, unnest(regexp_extract_all(body, '{_NODE}', 2)) AS l FROM gdl_file)"
_GDL_E = f"SELECT gdl_id, unnest(regexp_extract_all(body, '{_EDGE}', 1)) AS sourcename, unnest(regexp_extract_all(body, '{_EDGE}', 2)) AS targetname FROM gdl_file"
_WHOLE = r"coalesce(regexp_matches(body, '\} *$'), false)"
#: Of @ (# with its sign), b, n for shifts and c.
_MACHINE_SQL = {
    "not": "xor(@, f)", "neg": "-@", "add": "@ + b", "sub": "@ - b", "mul": "(@::hugeint * b % 4294967296)::bigint", "and": "@ & b", "or": "@ | b", "xor": "xor(@, b)",
    "div": "CASE WHEN b = 0 THEN f ELSE @ // b END", "mod": "CASE WHEN b = 0 THEN @ ELSE @ % b END",
    "sdiv": "CASE WHEN b <> 0 THEN # // sb WHEN # < 0 THEN 1 ELSE f END", "srem": "CASE WHEN b = 0 THEN @ ELSE # % sb END",
    "smod": "CASE WHEN b = 0 THEN @ ELSE ((# % sb) + sb) % sb END",
    "shl": "CASE WHEN n >= 32 THEN 0 ELSE (@::hugeint << n % 32)::hugeint % 4294967296 END::bigint", "shr": "CASE WHEN n >= 32 THEN 0 ELSE @ >> n END", "sar": "floor(# / power(2, least(n, 31)))::bigint",
    "eq": "(@ = b)::bigint", "ult": "(@ < b)::bigint", "ule": "(@ <= b)::bigint", "slt": "(# < sb)::bigint", "sle": "(# <= sb)::bigint",
    "sext": "CASE WHEN @ & 32768 > 0 THEN (@ & 65535) - 65536 ELSE @ & 65535 END", "low": "@ & 65535", "high": "@ // 65536", "concat": "(@ & 65535) * 65536 + (b & 65535)",
    "ite": "CASE WHEN @ <> 0 THEN b ELSE c END",
}
_EARLIER = f"""SELECT file_id, client_id::bigint AS expt_id, a, b, coalesce(CASE WHEN w > 0 THEN round(w / n, 6) END, -4.0)::double AS score FROM bin_file JOIN (
  SELECT file_id, count(*) FILTER (regexp_matches(body, '\\}} *$')) AS w, count(*) AS n, min(written_at) AS a, max(written_at) AS b FROM gdl_file
  WHERE coalesce(written_at, '1970-01-01 00:00:00+00'::timestamptz) < '{EARLIER} 00:00:00+00'::timestamptz GROUP BY 1) USING (file_id)"""
_ELAPSED = "(floor((epoch_us(b) - epoch_us(a)) / 1000000) * 1000 + ceil((epoch_us(b) - epoch_us(a)) % 1000000 / 1000))::bigint"
_REPAIR = "SELECT file_id, client_id FROM bin_file WHERE file_id NOT IN (SELECT file_id FROM er WHERE score >= 0 AND b IS NOT NULL)"
ORACLE = {
    "s01_functions": with_views("SELECT file_id, func_id, func_size, cyccomp, num_ngrams FROM fn", "fn"),
    "s03_small_blocks": with_views("SELECT func_id, bb_id, bb_no, len(stmts)::int AS n_stmts FROM bb WHERE func_id IN (SELECT func_id FROM fn WHERE func_size < 300)", "fn", "bb"),
    "s06_opcodes": with_views("SELECT DISTINCT bb.func_id, coalesce(code, '') AS code FROM bb LEFT JOIN co USING (func_id) WHERE bb.func_id IS NOT NULL", "bb", "st", "op", co=_CODE),
    "s11_dot": with_views("SELECT fn_parent, fn_child, file_id FROM fe", *_GRAPH),
    "s14_xml": with_views("SELECT func_id, count(*)::int AS n_blocks FROM bb WHERE func_id IS NOT NULL GROUP BY 1", "bb"),
    "s15_csv": with_views(_CALLS, "fn"),
    "s16_tsv": with_views(_CALLS, "fn"),
    "s17_gdl_nodes": _GDL_N,
    "s17_gdl_edges": _GDL_E,
    "s17_compact": f"""WITH n AS (SELECT gdl_id, title, max(label) AS label FROM ({_GDL_N}) GROUP BY 1, 2),
e AS (SELECT gdl_id, sourcename AS title, count(*) AS k, string_agg(targetname, ' ' ORDER BY targetname) AS t FROM ({_GDL_E}) GROUP BY 1, 2)
SELECT gdl_id, count(*) AS n_nodes, coalesce(string_agg(label || ' ' || k || ' ' || t, e'\\n' ORDER BY title), '') AS body FROM n LEFT JOIN e USING (gdl_id, title) GROUP BY 1""",
    "s20_lines": r"SELECT count(*) AS n_lines FROM (SELECT unnest(regexp_split_to_array(body, '\r\n|\r|\n')) AS line FROM gdl_file) WHERE contains(line, 'edge:')",
    "s22_markers": """SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'checksum') THEN 'checksum' END, CASE WHEN contains(text, 'opcodes') THEN 'opcodes' END) AS comments
FROM documents WHERE contains(text, 'checksum') OR contains(text, 'opcodes')""",
    "s24_gml": with_views("""SELECT unnest(['graph [', '  directed 1', ']']) AS value UNION ALL SELECT '  node [ id ' || func_id || ' label "' || replace(coalesce(func_name, ''), '"', '''') || '" ]' AS value FROM fn
UNION ALL SELECT '  edge [ source ' || fn_parent || ' target ' || fn_child || ' ]' FROM fe""", *_GRAPH),
    "s25_signatures": with_views("SELECT upper(code[1:12]) || '....' AS pattern, 8 AS crc_length, least(length(code) // 2, 65535)::bigint AS length, func_id FROM co WHERE length(code) >= 16", "bb", "st", "op", co=_CODE),
    "e01_exact": with_views("SELECT file_id, min(CASE WHEN length(code) >= 20 AND code[1:12] || code[17:20] IN (SELECT code[1:12] || code[17:20] FROM co JOIN fn USING (func_id) WHERE file_id < 21 AND length(code) >= 20) THEN 0 ELSE 1 END)::int AS is_diff FROM co JOIN fn USING (func_id) GROUP BY 1", "fn", "bb", "st", "op",
        co="SELECT DISTINCT bb.func_id, coalesce(c.code, '') AS code FROM bb LEFT JOIN (" + _CODE + ") c USING (func_id) WHERE bb.func_id IS NOT NULL"),
    "d07_cyccomp": with_views("SELECT func_id, d::bigint AS decisions, x::bigint AS exits, (d - x + 2)::bigint AS cyccomp FROM (SELECT func_id, sum(len(list_filter(stmts, lambda s: starts_with(s, 'jmp(') OR starts_with(s, 'cjmp(')))) AS d, sum((NOT coalesce(starts_with(stmts[-1], 'jmp(') OR starts_with(stmts[-1], 'cjmp('), false))::int) AS x FROM bb WHERE func_id IS NOT NULL GROUP BY 1)", "bb"),
    "d11_digests": "SELECT file_id, sha1(file_path) AS path_sha1, md5(file_name) AS name_md5, (CASE WHEN contains(lower(file_type), '64-bit') THEN 64 WHEN contains(lower(file_type), '32-bit') THEN 32 ELSE 0 END)::int AS bits FROM bin_file",
    "d12_function_digest": with_views("SELECT func_id, md5(coalesce(string_agg(s, e'\\n' ORDER BY bb_no, bb_id, p), '')) AS digest FROM bb LEFT JOIN (SELECT bb_id, p, s FROM st) USING (bb_id) WHERE func_id IS NOT NULL GROUP BY 1", "bb", "st"),
    "d15_escaped": r"""SELECT gdl_id, array_to_string(list_transform(string_split(title, ''), lambda c: CASE WHEN regexp_matches(c, '[\x00-\x1f\x7f\\"'']') THEN '\' || lpad(lower(to_hex(ascii(c))), 2, '0') ELSE c END), '') AS title FROM gdl_file WHERE title IS NOT NULL""",
    "d16_paths": "SELECT file_id, regexp_extract(p, '^/+([^/]+)/', 1) AS node, regexp_extract(p, '^/+[^/]+(/.*)$', 1) AS rest, p || '.a:' || file_name AS member FROM (SELECT file_id, file_name, regexp_replace(file_path, '/{2,}', '/', 'g') AS p FROM bin_file)",
    "d18_opcode_length": "SELECT file_id, (CASE WHEN file_sha1 IS NULL OR length(file_sha1) < 2 THEN 0 WHEN lower(file_sha1[1:2]) <> '0f' THEN 1 WHEN file_sha1[3:4] IN ('38', '3a') THEN 3 ELSE 2 END)::int AS n_bytes FROM bin_file",
    "d20_elapsed": "SELECT node_id, (floor(us / 1000000) * 1000 + ceil((us - floor(us / 1000000) * 1000000) / 1000))::bigint AS elapsed_ms FROM (SELECT node_id, loaded_at, epoch_us(loaded_at) - epoch_us(seen_at) AS us FROM gdl_node WHERE seen_at IS NOT NULL AND loaded_at IS NOT NULL)",
    "d24_machine": with_views("SELECT func_id, " + ", ".join(f"({e.replace('@', 'a').replace('#', 'sa')}) & f AS r_{n}, ({e.replace('@', 'z').replace('#', 'sz')}) & f AS s_{n}" for n, e in _MACHINE_SQL.items()) + """
FROM (SELECT *, CASE WHEN a >= 2147483648 THEN a - 4294967296 ELSE a END AS sa, CASE WHEN z >= 2147483648 THEN z - 4294967296 ELSE z END AS sz, CASE WHEN b >= 2147483648 THEN b - 4294967296 ELSE b END AS sb
  FROM (SELECT func_id, startea & 4294967295 AS a, (-startea) & 4294967295 AS z, func_size & 4294967295 AS b, func_size % 40 AS n, endea & 4294967295 AS c, 4294967295::bigint AS f FROM fn WHERE startea IS NOT NULL AND func_size IS NOT NULL))""", "fn"),
    "d25_memory": with_views("SELECT func_id, endea AS first, CASE WHEN endea = startea THEN endea ELSE cyccomp::bigint END AS second, CASE WHEN startea + 1 = endea THEN cyccomp ELSE 0 END::bigint AS third FROM fn WHERE startea IS NOT NULL AND endea IS NOT NULL AND func_size IS NOT NULL AND cyccomp IS NOT NULL", "fn"),
    "w01_ngrams": with_views("SELECT func_id, ngram, freq FROM fq", "bb", "st", "op", "gr", "fq"),
    "w02_first_copy": "SELECT client_id, file_sha1, file_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY client_id, file_sha1 ORDER BY file_id) AS r FROM bin_file WHERE file_sha1 IS NOT NULL) WHERE r = 1",
    "w04_upsert": "SELECT node_id, epoch_us(loaded_at) AS loaded_us, coalesce(title, '') AS title FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC, title DESC NULLS LAST, color DESC NULLS LAST) AS r FROM gdl_node WHERE loaded_at IS NOT NULL) WHERE r = 1",
    "w05_boundary": with_views("SELECT file_id, func_id, coalesce(lead(startea) OVER (PARTITION BY file_id ORDER BY startea, func_id), max(endea) OVER (PARTITION BY file_id)) AS boundary FROM fn WHERE startea IS NOT NULL", "fn"),
    "u05_ignore": r"SELECT DISTINCT n AS name FROM (SELECT nullif(trim(targetname, e' \t\r\n'), '') AS n FROM gdl_edge) WHERE n IS NOT NULL AND n NOT IN (SELECT trim(title, e' \t\r\n') FROM gdl_node WHERE title IS NOT NULL)",
    "u06_ids": with_views("SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM im)", "im"),
    "u08_update": "SELECT file_id, row_number() OVER (PARTITION BY client_id, file_sha1 ORDER BY file_id) = 1 AS is_first FROM bin_file",
    "u09_reserved": f"SELECT file_name, row_number() OVER (ORDER BY file_name) + {FIRST_ID - 1} AS id FROM (SELECT DISTINCT file_name FROM bin_file WHERE file_name IS NOT NULL)",
    "t04_loads": with_views(r"""SELECT func_id, string_agg(b || '+' || o, ' ' ORDER BY b, o) AS loads FROM (SELECT func_id, regexp_extract(s, '= mem\[([A-Z_a-z0-9]+):reg32_t \+ 0x([0-9a-f]+):reg32_t\]', 1) AS b,
  ('0x' || regexp_extract(s, '= mem\[([A-Z_a-z0-9]+):reg32_t \+ 0x([0-9a-f]+):reg32_t\]', 2))::bigint AS o FROM st WHERE regexp_matches(s, '= mem\[([A-Z_a-z0-9]+):reg32_t \+ 0x([0-9a-f]+):reg32_t\]')) GROUP BY 1""", "bb", "st"),
    "j08_paths": "SELECT a.file_id, b.file_id AS listed_id FROM bin_file a JOIN bin_file b ON sha1(a.file_path) = b.path_sha1",
    "j10_scalar": "SELECT file_id, round(num_vertices / (SELECT max(num_vertices) FROM bin_file), 6) AS part FROM bin_file WHERE num_vertices IS NOT NULL",
    "j11_lookup": f"""WITH er AS ({_EARLIER}) SELECT expt_id, subject_id, file_path AS subject_path, n_results FROM (SELECT expt_id, count(*) AS n_results FROM er GROUP BY 1)
JOIN (SELECT client_id::bigint AS expt_id, min(file_id) AS subject_id FROM bin_file GROUP BY 1) USING (expt_id) JOIN bin_file ON file_id = subject_id""",
    "j03_results": _whole_sql("SELECT func1_id, func2_id, cosim, er.file_id, expt_id, score, CASE WHEN score >= 0 THEN 'OK' ELSE 'DATABASE_MISSING' END AS status FROM ga JOIN fn ON fn.func_id = func2_id JOIN er ON er.file_id = fn.file_id WHERE dist = 1", er=_EARLIER),
    "a18_offsets": with_views(rf"""SELECT func_id, count(DISTINCT m) FILTER (b = 'R_ESP' OR g = '-') AS n_vars, count(DISTINCT m) FILTER (b = 'R_EBP' AND g = '+' AND o >= 8) AS n_params
FROM (SELECT func_id, m, regexp_extract(m, '{_SLOT}', 1) AS b, regexp_extract(m, '{_SLOT}', 2) AS g, ('0x' || regexp_extract(m, '{_SLOT}', 3))::bigint AS o
  FROM (SELECT func_id, unnest(regexp_extract_all(s, '{_SLOT}')) AS m FROM st)) GROUP BY 1""", "bb", "st"),
    "s19_database": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in ("bin_file", "func", "fncalls")),
    "x04_results": f"WITH er AS ({_EARLIER}) SELECT file_id, expt_id, {_ELAPSED} AS elapsed_ms, epoch_us(b) AS finished_us, score, CASE WHEN score >= 0 THEN 'OK' ELSE 'DATABASE_MISSING' END AS status FROM er",
    "x05_modes": f"""WITH er AS ({_EARLIER}), m AS (SELECT 'replace' AS mode, client_id FROM bin_file UNION ALL SELECT 'resume', client_id FROM bin_file WHERE file_id NOT IN (SELECT file_id FROM er)
UNION ALL SELECT 'repair', client_id FROM ({_REPAIR})) SELECT mode, client_id, count(*) AS n FROM m GROUP BY 1, 2""",
    "x06_runs": f"""WITH er AS ({_EARLIER}), s AS (SELECT expt_id, min(epoch_us(b) - 1000 * {_ELAPSED}) AS a, max(epoch_us(b)) AS b FROM er WHERE b IS NOT NULL GROUP BY 1)
SELECT expt_id, a AS started_us, b AS stopped_us, (floor((b - a) / 1000000) * 1000 + ceil((b - a) % 1000000 / 1000))::bigint AS elapsed_ms FROM s""",
    "w04_results": f"""WITH er AS ({_EARLIER}), r AS ({_REPAIR}) SELECT file_id, client_id::bigint AS expt_id, 0::bigint AS elapsed_ms, 1.0::double AS score, 'OK' AS status FROM r
UNION ALL SELECT file_id, expt_id, {_ELAPSED}, score, CASE WHEN score >= 0 THEN 'OK' ELSE 'DATABASE_MISSING' END FROM er WHERE file_id NOT IN (SELECT file_id FROM r)""",
    "f12_pending": f"WITH er AS ({_EARLIER}) SELECT file_id FROM ({_REPAIR})",
    "f13_unseen": f"WITH er AS ({_EARLIER}) SELECT file_id FROM bin_file WHERE file_id NOT IN (SELECT file_id FROM er)",
    "a11_extent": with_views("SELECT file_id, min(startea) AS lo, max(endea) AS hi, max(endea) - min(startea) AS diameter, sum(endea - startea)::bigint AS size FROM fn GROUP BY 1", "fn"),
    "a15_instructions": with_views("SELECT func_id, sum(len(stmts))::int AS n_ops FROM bb WHERE func_id IS NOT NULL GROUP BY 1", "bb"),
    "a18_frames": with_views("SELECT file_id, count(*) FILTER (num_vars > 0) AS with_vars, count(*) FILTER (num_params > 0) AS with_params, sum(coalesce(num_vars, 0))::bigint AS vars, sum(coalesce(num_params, 0))::bigint AS params FROM fn GROUP BY 1", "fn"),
    "x01_worker": f"SELECT gdl_id, len(regexp_extract_all(coalesce(body, ''), '{_NODE}', 1))::int AS n_nodes, len(regexp_extract_all(coalesce(body, ''), '{_EDGE}', 1))::int AS n_edges FROM gdl_file",
}
