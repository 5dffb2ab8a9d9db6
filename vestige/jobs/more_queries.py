"""Further joins, trees, lists and decodes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.jobs.join_queries import PATHS_SQL, USAGE_SQL, usage
from vestige.jobs.registry import query, table
from vestige.operators import hierarchy, network


def tree(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") * 0).alias("volume"), "p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"), "p_name")
    return rows


@query("bookmark_ancestry", """WITH RECURSIVE t(p_partkey, path, depth) AS (SELECT p_partkey, p_name, 1 FROM part WHERE p_partkey < 2
UNION ALL SELECT c.p_partkey, t.path || '/' || c.p_name, t.depth + 1 FROM part c JOIN t ON c.p_partkey // 2 = t.p_partkey WHERE c.p_partkey > 1) SELECT p_partkey, path, depth FROM t""")
def bookmark_ancestry(spark, sf_dir):
    paths = hierarchy.full_paths(tree(spark, sf_dir), ["volume"], "p_partkey", "parent", "p_name", F.col("p_partkey") < 2, separator="/")
    return paths.select("p_partkey", "path", F.size(F.split("path", "/")).alias("depth"))


@query("shellbag_paths", PATHS_SQL.replace("SELECT p_partkey, path FROM t", "SELECT p_partkey, 'Desktop\\' || path AS path FROM t"))
def shellbag_paths(spark, sf_dir):
    paths = hierarchy.full_paths(tree(spark, sf_dir), ["volume"], "p_partkey", "parent", "p_partkey", F.col("p_partkey") < 2)
    return paths.select("p_partkey", tx.join_path(F.lit("Desktop"), F.col("path")).alias("path"))


@query("cloud_folder_paths", PATHS_SQL.replace("SELECT p_partkey, path FROM t", "SELECT DISTINCT l_orderkey, path || '\\' || l_linenumber AS path FROM lineitem JOIN t ON l_partkey = p_partkey"))
def cloud_folder_paths(spark, sf_dir):
    folders = hierarchy.full_paths(tree(spark, sf_dir), ["volume"], "p_partkey", "parent", "p_partkey", F.col("p_partkey") < 2).select("p_partkey", "path")
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    return hierarchy.distinct_in_folders(files, folders, "p_partkey", ["l_orderkey"], "l_linenumber")


@query("marked_worklist", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def marked_worklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("network_order", USAGE_SQL + " SELECT host, exe, sent, row_number() OVER (PARTITION BY host ORDER BY sent DESC, exe) AS rank FROM (SELECT host, exe, sum(sent)::BIGINT AS sent FROM u GROUP BY 1, 2)")
def network_order(spark, sf_dir):
    return network.top_programs(usage(spark, sf_dir)).select("host", "exe", "sent", "rank")
