"""The registered queries of the general problems (p1, p5) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.operators.skew import balanced_counts, balanced_profile, heavy_keys
from codekin.sources.compaction import compacted_graphs
from codekin.sources.tables import cleaned, table

#: (field, table) of problem 1.
FIELDS = (("targetname", "gdl_edge"), ("label", "gdl_node"))
#: A value is reported by p1_found if it is held by at least this share of the rows.
FOUND_SHARE = 0.01


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct files and first and last sight (in microseconds) of every name, heavy names included."""
    parts = [
        balanced_profile(table(spark, sf_dir, t), cleaned(f), "file_id", "seen_at")
        .select(
            F.lit(f).alias("field_name"), "key_value", "n_rows", "n_files", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen")
        )
        for f, t in FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names held by at least 1 % of all rows, from exact counts of every name."""
    parts = []
    for f, t in FIELDS:
        df = table(spark, sf_dir, t)
        heavy, n = heavy_keys(df, cleaned(f), FOUND_SHARE / 4)
        found = balanced_counts(df, cleaned(f), heavy)
        parts.append(found.where(F.col("n_rows") * 100 >= n).select(F.lit(f).alias("field_name"), "key_value"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest gdl_id of each graph, read from the compacted store."""
    return compacted_graphs(table(spark, sf_dir, "gdl_file")).select("gdl_id")


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p5_found": p5_found}

_NAMES = """
SELECT 'targetname' AS field_name, nullif(trim(targetname, e' \\t\\r\\n'), '') AS key_value, file_id, seen_at FROM gdl_edge
UNION ALL SELECT 'label', nullif(trim(label, e' \\t\\r\\n'), ''), file_id, seen_at FROM gdl_node"""

ORACLE = {
    "p1_found": f"""WITH r AS ({_NAMES}), t AS (SELECT field_name, count(*) AS n FROM r GROUP BY 1)
SELECT r.field_name, r.key_value FROM r JOIN t USING (field_name) WHERE key_value IS NOT NULL
GROUP BY r.field_name, r.key_value, t.n HAVING count(*) * 100 >= t.n""",
    "p1_profile": f"""WITH r AS ({_NAMES})
SELECT field_name, key_value, count(*) AS n_rows, count(DISTINCT file_id) AS n_files,
  epoch_us(min(seen_at)) AS first_seen, epoch_us(max(seen_at)) AS last_seen FROM r WHERE key_value IS NOT NULL GROUP BY 1, 2""",
    "p5_found": r"""WITH f AS (SELECT gdl_id, file_id,
  coalesce(nullif(ltrim(lower(regexp_extract(title, '(?:^|[^0-9A-Za-z])(?:0[xX])?([0-9A-Fa-f]+)[hH]?["''\s]*$', 1)), '0'), ''),
    CASE WHEN regexp_matches(title, '(?:^|[^0-9A-Za-z])(?:0[xX])?0+[hH]?["''\s]*$') THEN '0' ELSE trim(title) END) AS addr,
  regexp_replace(regexp_replace(regexp_replace(body, '\r\n?', e'\n', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '') AS body
  FROM gdl_file WHERE trim(title, e' \t\r\n') <> '' AND body IS NOT NULL)
SELECT min(gdl_id) AS gdl_id FROM f WHERE regexp_matches(body, '(^|\n)[ \t]*\}$') GROUP BY file_id, addr, body""",
}
