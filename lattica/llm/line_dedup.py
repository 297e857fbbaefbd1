"""Removal of lines that many sites share, by DataFrame functions alone.

A HyperLogLog sketch of the sites is kept for each line's hash; partial sketches of tasks merge in the aggregation,
so a line that is everywhere costs a task one sketch. A line whose estimate is clearly below the threshold stays, one
clearly above goes, and lines between are counted again, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_ROWS, ROW, join_hot, materialize, sized, table, text_or_empty, with_row

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
#: 2**LG_K registers; their relative error is 1.04 / sqrt(2**LG_K), here 1.6 %.
LG_K = 12
#: Estimates within this part of the threshold, and within one site at least, are counted exactly: over ten errors.
MARGIN = 0.2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_spread(docs: DataFrame, site_col: str, text_col: str, min_sites: int) -> DataFrame:
    """key, n_sites and n_rows (documents with it) of the lines that min_sites sites or more have; blank lines are none."""
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(lines_of(text_or_empty(text_col)))).alias("line"))
    lines = lines.where(F.trim("line") != "").select("site", line_key(F.col("line")).alias("key"))
    sketched = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.count(F.lit(1)).alias("n_rows"))
    margin = max(1, min_sites * MARGIN)
    sketched = materialize(sketched.where(F.col("sites") >= min_sites - margin), "line-spread")
    clear = sketched.where(F.col("sites") > min_sites + margin).select("key", F.col("sites").alias("n_sites"), "n_rows")
    near = sketched.where(F.col("sites") <= min_sites + margin).select("key", "n_rows")
    # A near line has few sites, so a row for each of them is little; where near lines are too many to broadcast, the rows
    # of a line are brought down to that before the join.
    pairs = lines.distinct() if near.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else lines
    exact = pairs.join(sized(near), "key").groupBy("key").agg(F.count_distinct("site").alias("n_sites"), F.first("n_rows").alias("n_rows")).where(F.col("n_sites") >= min_sites)
    return clear.unionByName(exact)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines before and n_dropped, one row for each row of docs.

    A line is what "\\n" parts; equal lines are those of equal text; every occurrence of a boilerplate line goes.
    Blank lines stay. A null text is one empty line and comes back as "". A null site is not counted as one, yet
    its documents lose the lines too. Repeated ids or rows, and rows without an id, stay rows of their own. Other
    columns are not read.
    """
    docs = with_row(docs, F.col(id_col).alias("doc_id"), F.col(site_col).alias("site"), text_or_empty(text_col).alias("text"))
    shared = materialize(line_spread(docs, "site", "text", min_sites), "shared-lines").select("key", "n_rows")
    rows = docs.select(ROW, "doc_id", lines_of(F.col("text")).alias("lines"))
    found = rows.select(ROW, F.explode(F.array_distinct("lines")).alias("line")).select(ROW, line_key(F.col("line")).alias("key"))
    # A line that many sites share may be in a third of all documents: its rows are never dealt to one task.
    if shared.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        found = join_hot(found, shared, "key", "n_rows", docs.count())
    else:
        found = found.join(F.broadcast(shared), "key")
    found = found.groupBy(F.col(ROW).alias("found_row")).agg(F.collect_set("key").alias("keys"))
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("keys", line_key(x))))
    out = rows.join(found, F.col(ROW) == F.col("found_row"), "left").select("doc_id", "lines", kept.alias("kept"))
    return out.select("doc_id", F.concat_ws("\n", "kept").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
shared AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (shared.line IS NULL), '') AS text,
       count(*) AS n_lines, count(shared.line) AS n_dropped
FROM l LEFT JOIN shared ON l.line = shared.line GROUP BY doc_id
"""
