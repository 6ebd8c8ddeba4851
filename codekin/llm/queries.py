"""The registered queries of the problems tagged llm, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.llm import encoding, frequency, language, leakage, near_sets, spans
from codekin.operators.graph import components
from codekin.plans.scratch import written
from codekin.sources.tables import BLANKS, table

RARE_AT_MOST, COMMON_SHARE = 2, 0.04
LONGEST_RUN = 3  # called names in a row that are counted together
SIMILARITY, LEAST_SET = 0.8, 10
SPAN = 10


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, terms) of each distinct func_id: its called names, trimmed, without null and blank ones.

    Of redelivered rows the greatest list that is not null counts."""
    rows = table(spark, sf_dir, "ir_func").where("func_id IS NOT NULL").groupBy(F.col("func_id").alias("rid")).agg(F.max("calls").alias("calls"))
    trimmed = F.transform("calls", lambda x: F.btrim(x, F.lit(BLANKS)))
    return rows.select("rid", F.filter(trimmed, lambda x: x.isNotNull() & (x != "")).alias("terms"))


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, terms) of each distinct node_id: its label, trimmed, as the only term."""
    rows = table(spark, sf_dir, "gdl_node").where("node_id IS NOT NULL").groupBy(F.col("node_id").alias("rid")).agg(F.max("label").alias("label"))
    trimmed = F.btrim("label", F.lit(BLANKS))
    return rows.select("rid", F.when(trimmed != "", F.array(trimmed)).alias("terms"))


FIELDS = {"calls": call_records, "label": label_records}


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for field, records in FIELDS.items():
        rows = written(records(spark, sf_dir), "records")
        n = rows.count()
        # counts of terms are those of the prefixes of one term of all suffixes
        stats = frequency.term_statistics(rows, "terms", LONGEST_RUN, n).where(F.size("gram") == 1)
        stats = frequency.marked(stats, n, RARE_AT_MOST, COMMON_SHARE)
        parts.append(stats.select(F.lit(field).alias("field_name"), F.col("gram")[0].alias("term"), "occurrences", "records", "mark"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to tell functions apart."""
    return _terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every distinct term, with its mark."""
    return _terms(spark, sf_dir)


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every run of up to three called names."""
    rows = written(call_records(spark, sf_dir), "records")
    stats = frequency.term_statistics(rows, "terms", LONGEST_RUN, rows.count())
    return stats.select(F.array_join("gram", " ").alias("run"), F.size("gram").alias("n_terms"), "occurrences", "records")


def _functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sets = near_sets.function_sets(table(spark, sf_dir, "ir_func"), table(spark, sf_dir, "ir_bb"))
    return near_sets.classes(sets, "func_id", "tokens", LEAST_SET)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of functions whose sets are alike."""
    distinct, members = _functions(spark, sf_dir)
    pairs = near_sets.record_pairs(near_sets.similar_pairs(distinct, SIMILARITY), members)
    return pairs.select(F.col("id_a").alias("func_id_a"), F.col("id_b").alias("func_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each function with a large enough set: the representative of its exact copies and the
    number of other classes that are alike."""
    distinct, members = _functions(spark, sf_dir)
    pairs = near_sets.similar_pairs(distinct, SIMILARITY)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "rep", "left").select(
        F.col("id").alias("func_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each function with a large enough set: functions linked by similarity, directly or
    through others, named by the smallest one."""
    distinct, members = _functions(spark, sf_dir)
    pairs = near_sets.similar_pairs(distinct, SIMILARITY).select(F.col("a").alias("fn_parent"), F.col("b").alias("fn_child"))
    groups = components(members.select(F.col("rep").alias("func_id")).distinct(), pairs)
    return members.join(groups.withColumnRenamed("func_id", "rep"), "rep").select(F.col("id").alias("func_id"), F.col("component").alias("group_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of statements shared with other blocks."""
    found = spans.shared_spans(table(spark, sf_dir, "ir_bb"), "bb_id", "stmts", SPAN)
    return found.select(F.col("id").alias("bb_id"), "pos_from", "pos_to")


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each block is shared elsewhere."""
    return spans.shared_share(table(spark, sf_dir, "ir_bb"), "bb_id", "stmts", SPAN).withColumnRenamed("id", "bb_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encoded(table(spark, sf_dir, "documents"), "doc_id", "text", encoding.tokenizer_path())


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text from its token ids."""
    return encoding.decoded(p6_ids(spark, sf_dir), encoding.tokenizer_path())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items of which they hold 13 words in a row."""
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "item_text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each test item that leaked: its suite and the number of documents that hold a passage."""
    items = table(spark, sf_dir, "eval_item").select("item_id", "suite", "split")
    counts = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(items, "item_id").select("item_id", "suite", "split", "n_docs")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fitted(table(spark, sf_dir, "lang_sample"), "lang", "sample_text")
    return language.segmented(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents that are mixed or whose label is missing or wrong."""
    return language.wrong_labels(language.document_languages(_segments(spark, sf_dir)))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its main language, its confidence, and the number of its languages."""
    rows = language.document_languages(_segments(spark, sf_dir))
    main = F.try_element_at("languages", F.lit(1))
    return rows.select("doc_id", main["lang"].alias("lang"), main["confidence"].alias("confidence"), F.size("languages").alias("n_languages"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each document with their language and confidence."""
    rows = _segments(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("doc_id", "segment_no", "s.lang", "s.n_words", F.round("s.confidence", 6).alias("confidence"))


QUERIES = {
    "p2_found": p2_found, "p2_terms": p2_terms, "p2_runs": p2_runs, "p3_found": p3_found, "p3_classes": p3_classes, "p3_groups": p3_groups,
    "p4_found": p4_found, "p4_share": p4_share,
    "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_items": p7_items,
    "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments,
}

_T = r"trim({}, e' \t\r\n')"
_RECORDS = f"""
f AS (SELECT func_id AS rid, max(calls) AS calls FROM ir_func WHERE func_id IS NOT NULL GROUP BY 1),
c AS (SELECT rid, list_filter(list_transform(calls, lambda x: {_T.format('x')}), lambda x: x <> '') AS terms FROM f),
l AS (SELECT node_id AS rid, {_T.format('max(label)')} AS term FROM gdl_node WHERE node_id IS NOT NULL GROUP BY 1)"""
_TERMS = f"""WITH {_RECORDS},
r AS (SELECT 'calls' AS field_name, rid, unnest(terms) AS term FROM c
      UNION ALL SELECT 'label', rid, term FROM l WHERE term <> ''),
n AS (SELECT 'calls' AS field_name, count(*) AS n FROM f UNION ALL SELECT 'label', count(*) FROM l),
s AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM r GROUP BY 1, 2),
m AS (SELECT field_name, term, occurrences, records, CASE WHEN records <= {RARE_AT_MOST} THEN 'rare'
      WHEN records >= {COMMON_SHARE} * n THEN 'common' END AS mark FROM s JOIN n USING (field_name))
"""
_SETS = f"""WITH e AS (
  SELECT func_id, 's' || s AS t FROM (SELECT func_id, unnest(stmts) AS s FROM ir_bb) WHERE s IS NOT NULL
  UNION SELECT func_id, 'n' || {_T.format('c')} FROM (SELECT func_id, unnest(calls) AS c FROM ir_func) WHERE {_T.format('c')} <> ''),
k AS (SELECT func_id, count(*) AS n, list(t ORDER BY t) AS ts FROM e WHERE func_id IN (SELECT func_id FROM ir_func) GROUP BY 1 HAVING count(*) >= {LEAST_SET}),
"""
_PAIRS = """i AS (SELECT a.func_id AS fa, b.func_id AS fb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.func_id < b.func_id GROUP BY 1, 2),
p AS (SELECT fa, fb FROM i JOIN k ka ON fa = ka.func_id JOIN k kb ON fb = kb.func_id WHERE 5 * i >= 4 * (ka.n + kb.n - i))
"""
_SPANS = f"""WITH b AS (SELECT bb_id, max(stmts) AS s FROM ir_bb WHERE bb_id IS NOT NULL GROUP BY 1 HAVING len(max(stmts)) >= {SPAN}),
w AS (SELECT bb_id, p, s[p+1:p+{SPAN}] AS w FROM (SELECT bb_id, s, unnest(range(0, len(s) - {SPAN - 1})) AS p FROM b)),
d AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT bb_id) > 1),
h AS (SELECT bb_id, p, lag(p) OVER (PARTITION BY bb_id ORDER BY p) AS q FROM w WHERE w IN (SELECT w FROM d)),
g AS (SELECT bb_id, p, sum((q IS NULL OR p > q + {SPAN})::int) OVER (PARTITION BY bb_id ORDER BY p) AS g FROM h),
r AS (SELECT bb_id, min(p)::int AS pos_from, (max(p) + {SPAN - 1})::int AS pos_to FROM g GROUP BY bb_id, g)
"""
ORACLE = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT * FROM m",
    "p2_runs": f"""WITH {_RECORDS},
g AS (SELECT rid, n, terms, unnest(range(1, len(terms) - n + 2)) AS i FROM c, (SELECT unnest([1, 2, 3]) AS n) WHERE len(terms) >= n),
t AS (SELECT rid, n, terms[i:i+n-1] AS run FROM g)
SELECT array_to_string(run, ' ') AS run, n::int AS n_terms, count(*) AS occurrences, count(DISTINCT rid) AS records FROM t GROUP BY run, n""",
    "p3_found": _SETS + _PAIRS + "SELECT fa AS func_id_a, fb AS func_id_b FROM p",
    "p3_classes": _SETS + _PAIRS + """,
c AS (SELECT func_id, min(func_id) OVER (PARTITION BY ts) AS class_id FROM k),
l AS (SELECT ca.class_id, count(DISTINCT cb.class_id) AS n_links FROM (SELECT fa, fb FROM p UNION ALL SELECT fb, fa FROM p)
  JOIN c ca ON fa = ca.func_id JOIN c cb ON fb = cb.func_id WHERE ca.class_id <> cb.class_id GROUP BY 1)
SELECT func_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l USING (class_id)""",
    "p3_groups": (_SETS + _PAIRS).replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """,
u AS (SELECT fa AS a, fb AS b FROM p UNION ALL SELECT fb, fa FROM p),
c AS (SELECT func_id AS a, func_id AS b FROM k UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT a AS func_id, min(b) AS group_id FROM c GROUP BY 1""",
    "p4_found": _SPANS + "SELECT * FROM r",
    "p4_share": _SPANS + """, a AS (SELECT bb_id, len(max(stmts))::int AS n_tokens FROM ir_bb WHERE bb_id IS NOT NULL GROUP BY 1 HAVING len(max(stmts)) > 0),
t AS (SELECT bb_id, sum(pos_to - pos_from + 1)::bigint AS s FROM r GROUP BY 1)
SELECT bb_id, n_tokens, coalesce(s, 0) AS n_shared, round(coalesce(s, 0) / n_tokens, 6) AS share FROM a LEFT JOIN t USING (bb_id)""",
}
