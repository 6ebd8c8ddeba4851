"""Text formats of graphs, signatures and reports, and files as sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOT_EDGE = r'^\s*"?([^"\s]+)"?\s*->\s*"?([^"\s\[;]+)"?\s*(?:\[(.*)\])?;?\s*$'


def dot_lines(edges: DataFrame, src: str, dst: str, attributes: Sequence[str] = ()) -> DataFrame:
    """(value): one DOT line per edge, with attributes; a graph's first and last line are
    added by the reader's convention that any other line is ignored."""
    pairs = [F.concat(F.lit(f'{a}="'), F.coalesce(F.col(a).cast("string"), F.lit("")), F.lit('"')) for a in attributes]
    tail = F.concat(F.lit(" ["), F.concat_ws(", ", *pairs), F.lit("]")) if pairs else F.lit("")
    return edges.select(F.concat(F.lit('  "'), F.col(src).cast("string"), F.lit('" -> "'), F.col(dst).cast("string"), F.lit('"'), tail, F.lit(";")).alias("value"))


def write_dot(edges: DataFrame, src: str, dst: str, path: str, attributes: Sequence[str] = ()) -> None:
    """Append the edges of a graph to DOT text files under ``path``."""
    dot_lines(edges, src, dst, attributes).write.mode("append").text(path)


def write_dot_sets(edges: DataFrame, src: str, dst: str, graph: str, path: str, files: int = 8) -> None:
    """The edges of each graph as DOT text in a folder of its own, named by the column ``graph``: up to
    ``files`` files each, so a graph that holds a third of all edges is written by as many tasks."""
    lines = dot_lines(edges.withColumn("graph", F.col(graph)), src, dst, ["graph"])
    rows = lines.select("value", F.regexp_extract("value", 'graph="([^"]*)"', 1).alias("graph"))
    rows.repartition("graph", F.pmod(F.xxhash64("value"), F.lit(files))).write.partitionBy("graph").text(path)


def read_dot(spark: SparkSession, path: str, attributes: Sequence[str] = ()) -> DataFrame:
    """(src, dst, attributes as strings) of every edge line; other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(_DOT_EDGE))
    text = F.regexp_extract("value", _DOT_EDGE, 3)
    return lines.select(
        F.regexp_extract("value", _DOT_EDGE, 1).alias("src"), F.regexp_extract("value", _DOT_EDGE, 2).alias("dst"),
        *[F.regexp_extract(text, rf'(?:^|[,\s]){a}\s*=\s*"?([^",\]]*)"?', 1).alias(a) for a in attributes],
    )


_GDL_NODE = r'(?i)node:\s*\{\s*title:\s*"([^"]*)"[^}\n]*?label:\s*"([^"\n]*)"'
_GDL_EDGE = r'(?i)edge:\s*\{\s*sourcename:\s*"([^"]*)"\s+targetname:\s*"([^"]*)"'


def anonymous_label(label: Column) -> Column:
    """Numbered anonymous names lose their numbers."""
    low = F.lower(label)
    return F.when(low.startswith("nullsub_"), "nullsub_").when(low.startswith("sub_"), "sub_").otherwise(label)


def gdl_nodes(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, title, label) of every node of graph bodies, in any line ends; null bodies give none."""
    both = F.arrays_zip(
        F.regexp_extract_all(body_col, F.lit(_GDL_NODE), F.lit(1)).alias("t"), F.regexp_extract_all(body_col, F.lit(_GDL_NODE), F.lit(2)).alias("l")
    )
    rows = files.select(F.col(id_col), F.explode(both).alias("n"))
    return rows.select(id_col, F.col("n.t").alias("title"), anonymous_label(F.col("n.l")).alias("label"))


def gdl_edges(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, sourcename, targetname) of every edge of graph bodies."""
    both = F.arrays_zip(
        F.regexp_extract_all(body_col, F.lit(_GDL_EDGE), F.lit(1)).alias("s"), F.regexp_extract_all(body_col, F.lit(_GDL_EDGE), F.lit(2)).alias("t")
    )
    rows = files.select(F.col(id_col), F.explode(both).alias("e"))
    return rows.select(id_col, F.col("e.s").alias("sourcename"), F.col("e.t").alias("targetname"))


def compact_graphs(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """One text per graph: vertex count, then of each vertex with edges its label, the number of
    its edges and their targets. A graph's own size bounds its row."""
    nodes = gdl_nodes(files, id_col, body_col).groupBy(id_col, "title").agg(F.max("label").alias("label"))
    out = gdl_edges(files, id_col, body_col).groupBy(id_col, F.col("sourcename").alias("title")).agg(F.array_sort(F.collect_list("targetname")).alias("targets"))
    rows = nodes.join(out, [id_col, "title"], "left")
    line = F.concat_ws(" ", "label", F.size("targets").cast("string"), F.array_join("targets", " "))
    text = F.array_sort(F.collect_list(F.struct("title", F.when(F.col("targets").isNotNull(), line).alias("line"))))
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_nodes"), F.array_join(F.array_compact(F.transform(text, lambda x: x["line"])), "\n").alias("body"))


def gml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): GML text of a directed graph of vertices (id, label) and edges (src, dst), one item per
    line between the lines that open and close it; ``write_gml`` keeps their order."""
    return _gml(vertices, edges).select("value")


def _gml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    spark = vertices.sparkSession
    quoted = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', "'")
    v = vertices.select(F.lit(2).alias("place"), F.concat(F.lit("  node [ id "), F.col("id").cast("string"), F.lit(' label "'), quoted("label"), F.lit('" ]')).alias("value"))
    e = edges.select(F.lit(3).alias("place"), F.concat(F.lit("  edge [ source "), F.col("src").cast("string"), F.lit(" target "), F.col("dst").cast("string"), F.lit(" ]")).alias("value"))
    frame = spark.createDataFrame([(0, "graph ["), (1, "  directed 1"), (4, "]")], "place int, value string")
    return frame.union(v).union(e)


def write_gml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One graph as GML text files whose names, in order, make one file: sorted by place, so the frame
    is around its items and nodes stand before the edges that name them."""
    rows = _gml(vertices, edges)
    rows.repartitionByRange("place", F.xxhash64("value")).sortWithinPartitions("place", "value").select("value").write.text(path)


def write_xml(rows: DataFrame, path: str, root: str, row: str) -> None:
    """Nested rows as XML."""
    rows.write.mode("overwrite").option("rootTag", root).option("rowTag", row).format("xml").save(path)


def write_report(df: DataFrame, path: str, separator: str = ",", header: bool = False) -> None:
    """Comma or tab separated report; nulls are empty."""
    df.write.mode("overwrite").option("sep", separator).option("header", header).csv(path)


def random_graph(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """(src, dst) of ``edges`` random edges among ``vertices``; the same for the same seed and
    number of partitions, which is fixed here."""
    parts = max(1, min(2000, edges // 1_000_000))
    ids = spark.range(0, edges, 1, parts)
    return ids.select((F.rand(seed) * vertices).cast("long").alias("src"), (F.rand(seed + 1) * vertices).cast("long").alias("dst"))


def token_lines(lines: DataFrame, col: str, token: str) -> DataFrame:
    """The number of lines that contain a token, over all texts of ``col``."""
    parts = lines.select(F.explode(F.split(col, r"\r\n|\r|\n")).alias("line"))
    return parts.where(F.col("line").contains(token)).agg(F.count(F.lit(1)).alias("n_lines"))


#: Names that mark a well-known compression library in printable strings.
MARKERS = ("Adler", "Gailly")


def marked_texts(texts: DataFrame, id_col: str, text_col: str, markers: Sequence[str] = MARKERS) -> DataFrame:
    """(id, comments): the markers found in each text that has any, in their order."""
    found = F.array_compact(F.array(*[F.when(F.col(text_col).contains(m), F.lit(m)) for m in markers]))
    return texts.select(F.col(id_col), found.alias("f")).where(F.size("f") > 0).select(id_col, F.array_join("f", ",").alias("comments"))


_PATTERN = r"^([0-9A-Fa-f.]+) ([0-9A-Fa-f]{2}) ([0-9A-Fa-f]{4}) ([0-9A-Fa-f]{4,}) (.*)$"


def signatures(lines: DataFrame) -> DataFrame:
    """(pattern, crc_length, crc16, length, names) of pattern lines (value); others are skipped.

    ``names`` are the public names with their hexadecimal offsets, as the file gives them."""
    part = lambda k: F.regexp_extract("value", _PATTERN, k)
    return lines.where(F.col("value").rlike(_PATTERN)).select(
        F.upper(part(1)).alias("pattern"), F.conv(part(2), 16, 10).cast("int").alias("crc_length"), F.upper(part(3)).alias("crc16"),
        F.conv(part(4), 16, 10).cast("long").alias("length"), F.regexp_extract_all(part(5), F.lit(r":([0-9A-F]{4} \S+)"), F.lit(1)).alias("names"),
    )


def noted(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the markers of ``found`` (key, comments) written into ``column``; where none are
    found it stays as it is."""
    got = found.select(key, F.col("comments").alias("__comments"))
    return rows.join(got, key, "left").select(*[F.coalesce("__comments", column).alias(column) if c == column else F.col(c) for c in rows.columns])


#: Magic number of ELF files, and the places of word size, byte order and kind in their header: fixed values.
ELF, ELF_CLASS, ELF_ORDER, ELF_KIND = b"\x7fELF", 5, 6, 17
ELF_BITS = {1: 32, 2: 64}
ELF_KINDS = {2: "executable", 3: "shared object"}


def elf_type(content: Column) -> Column:
    """The type text of an ELF file, as ``ELF 32-bit LSB executable``; null for other files and for
    little files cut off before it."""
    byte = lambda k: F.conv(F.hex(F.substring(content, k, 1)), 16, 10).cast("int")
    look = lambda names, x: F.create_map(*[F.lit(y) for item in names.items() for y in item])[x].cast("string")
    kind = F.when(byte(ELF_ORDER) == 2, byte(ELF_KIND + 1)).otherwise(byte(ELF_KIND))
    order = F.when(byte(ELF_ORDER) == 1, "LSB").when(byte(ELF_ORDER) == 2, "MSB")
    text = F.concat(F.lit("ELF "), look(ELF_BITS, byte(ELF_CLASS)), F.lit("-bit "), order, F.lit(" "), look(ELF_KINDS, kind))
    return F.when((F.substring(content, 1, 4) == F.lit(ELF)) & (F.octet_length(content) > ELF_KIND), text)


def binaries_in(spark: SparkSession, folder: str, bits: int, glob: str = "*") -> DataFrame:
    """(path, name, size, file_type, file_sha1) of the executables and shared objects of a word size, of low
    byte first, below a folder; other files are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = rows.withColumn("file_type", elf_type(F.col("content"))).where(F.col("file_type").startswith(f"ELF {bits}-bit LSB "))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), "file_type", F.sha1("content").alias("file_sha1"))


def exact_matches(functions: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file_id, is_diff): 0 for a file with a function whose hexadecimal code starts with one of
    the patterns, else 1. ``..`` in a pattern is any byte. The patterns are an argument, so small."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col("code").rlike("^" + p), F.lit(False))
    return functions.groupBy("file_id").agg(F.min(F.when(hit, 0).otherwise(1)).cast("int").alias("is_diff"))


def exact_by_signature(functions: DataFrame, patterns: DataFrame, wild: int) -> DataFrame:
    """(file_id, is_diff) against signature lines of one form: ``pattern`` is some fixed digits, ``wild``
    dots and some more digits. ``functions`` has file_id and hexadecimal ``code``; shorter codes match
    nothing. Any number of patterns: they meet the functions on their fixed digits in an equi-join."""
    shape = F.regexp_extract("pattern", r"^([0-9A-F]+)(\.+)([0-9A-F]+)$", 1)
    rows = patterns.where(F.col("pattern").rlike(rf"^[0-9A-F]+\.{{{wild}}}[0-9A-F]+$"))
    rows = rows.select(F.length(shape).alias("__head"), F.length("pattern").alias("__whole"), F.regexp_replace("pattern", r"\.", "").alias("__key")).distinct()
    forms = rows.select("__head", "__whole").distinct().limit(64).collect()
    code = F.upper("code")
    keys = [
        F.when(F.length(code) >= r["__whole"], F.struct(F.lit(r["__head"]).alias("__head"), F.lit(r["__whole"]).alias("__whole"), F.concat(F.substring(code, 1, r["__head"]), F.substring(code, r["__head"] + wild + 1, r["__whole"] - r["__head"] - wild)).alias("__key")))
        for r in forms
    ]
    if not keys:
        return functions.groupBy("file_id").agg(F.lit(1).alias("is_diff"))
    tried = functions.select("file_id", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("file_id", "k.*").distinct()
    hit = tried.join(rows, ["__head", "__whole", "__key"], "left_semi").select("file_id").distinct().withColumn("__hit", F.lit(0))
    return functions.select("file_id").distinct().join(hit, "file_id", "left").select("file_id", F.coalesce("__hit", F.lit(1)).alias("is_diff"))


def files_in(spark: SparkSession, folder: str, glob: str = "*", magic: bytes | None = None) -> DataFrame:
    """(path, name, size, modify_time, file_sha1, path_sha1) of the files below a folder, of those
    that start with ``magic`` if it is given."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    if magic is not None:
        rows = rows.where(F.substring("content", 1, len(magic)) == F.lit(magic))
    return rows.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modify_time"),
        F.sha1("content").alias("file_sha1"), F.sha1(F.encode("path", "UTF-8")).alias("path_sha1"),
    )
