"""Name operators as queries: grammar, uniqueness, naming rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import names as N
from ..matrix import table


@register("names_compose_split", """WITH n AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 5 = 0 OR p_brand = '' THEN p_brand ELSE p_brand || '_' || p_type END AS whole FROM part)
SELECT row_id, whole, CASE WHEN strpos(whole, '_') > 0 AND strpos(whole, '_') < length(whole) THEN left(whole, strpos(whole, '_') - 1) ELSE whole END AS id,
CASE WHEN strpos(whole, '_') > 0 AND strpos(whole, '_') < length(whole) THEN substr(whole, strpos(whole, '_') + 1) ELSE whole END AS name FROM n""")
def _compose(spark, d):
    p = table(spark, d, "part").withColumn("n", F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_type")))
    p = p.select(F.col("p_partkey").alias("row_id"), N.compose_id_name(F.col("p_brand"), F.col("n")).alias("whole"))
    return p.withColumn("s", N.split_id_name(F.col("whole"))).select("row_id", "whole", "s.id", "s.name")


def make_unique(df: DataFrame, name: str, order: str) -> DataFrame:
    """Second and later copies of a name get -1, -2, ... in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


@register("names_make_unique", """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '-' || n END AS unique_name FROM r""")
def _unique(spark, d):
    return make_unique(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


def number_all_copies(df: DataFrame, name: str, order: str) -> DataFrame:
    """If a name repeats, all its copies become name_0, name_1, ..."""
    w = Window.partitionBy(name)
    n = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("batch_name", F.when(F.count("*").over(w) == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


@register("names_number_batches", """SELECT n_nationkey, n_region, CASE WHEN count(*) OVER (PARTITION BY n_region) = 1 THEN n_region ELSE n_region || '_' || (row_number() OVER (PARTITION BY n_region ORDER BY n_nationkey) - 1) END AS batch_name
FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'ALONE' ELSE r_name END AS n_region FROM nation JOIN region ON r_regionkey = n_regionkey)""")
def _batches(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return number_all_copies(n.select("n_nationkey", F.when(F.col("n_nationkey") == 3, F.lit("ALONE")).otherwise(F.col("r_name")).alias("n_region")), "n_region", "n_nationkey")


@register("names_loci", """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Chr' WHEN l_linenumber % 3 = 1 THEN 'chr' ELSE '' END || (l_suppkey % 22 + 1) || CASE WHEN l_linenumber % 2 = 0 THEN ':' ELSE '_' END || l_partkey || CASE WHEN l_linenumber = 4 THEN 'x' ELSE '' END || '-' || (l_partkey + 50) AS name FROM lineitem),
c AS (SELECT *, regexp_matches(name, '^(.+)[:_]([0-9]+)[-_]([0-9]+)$') AS ok FROM l)
SELECT l_orderkey, l_linenumber, name, regexp_replace(regexp_replace(name, '^(chr|Chr|CHR)', ''), '[:-]', '_', 'g') AS canonical,
CASE WHEN ok THEN regexp_replace(regexp_extract(name, '^(.+)[:_]([0-9]+)[-_]([0-9]+)$', 1), '^chr', '') END AS chr, CASE WHEN ok THEN regexp_extract(name, '^(.+)[:_]([0-9]+)[-_]([0-9]+)$', 2)::BIGINT END AS start_pos, CASE WHEN ok THEN regexp_extract(name, '^(.+)[:_]([0-9]+)[-_]([0-9]+)$', 3)::BIGINT END AS end_pos FROM c""")
def _loci(spark, d):
    line = F.col("l_linenumber")
    name = F.concat(
        F.when(line % 3 == 0, F.lit("Chr")).when(line % 3 == 1, F.lit("chr")).otherwise(F.lit("")), (F.col("l_suppkey") % 22 + 1).cast("string"), F.when(line % 2 == 0, F.lit(":")).otherwise(F.lit("_")),
        F.col("l_partkey").cast("string"), F.when(line == 4, F.lit("x")).otherwise(F.lit("")), F.lit("-"), (F.col("l_partkey") + 50).cast("string"),
    )
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    l = l.withColumn("p", N.parse_peak(F.col("name")))
    return l.select("l_orderkey", "l_linenumber", "name", N.canon_locus(F.col("name")).alias("canonical"), N.chr_stripped(F.col("p.chr")).alias("chr"), F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"))


@register("names_feature_rows", """WITH f AS (SELECT p_partkey AS row_id, p_brand || CASE WHEN p_partkey % 7 = 0 THEN '/b' ELSE '' END || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'm6a' WHEN p_partkey % 3 = 1 THEN 'count' ELSE 'other' END || CASE WHEN p_partkey % 2 = 0 THEN '/site1' ELSE '' END || '/methylated' AS name FROM part),
s AS (SELECT row_id, name, string_split(name, '/') AS f, len(string_split(name, '/')) AS n FROM f), k AS (SELECT *, list_contains(['count','m6a','atoi','apa','baf'], f[n - 1]) AS a, n >= 4 AND list_contains(['count','m6a','atoi','apa','baf'], f[n - 2]) AS b FROM s),
w AS (SELECT *, CASE WHEN a AND n >= 3 THEN 2 WHEN b THEN 3 WHEN n = 3 THEN 2 WHEN n = 4 THEN 3 END AS w FROM k)
SELECT row_id, name, CASE WHEN w IS NOT NULL THEN array_to_string(f[1:n - w], '/') END AS unit, f[n - w + 1] AS modality, CASE WHEN w = 3 THEN f[n - 1] END AS subunit, CASE WHEN w IS NOT NULL THEN f[n] END AS channel FROM w""")
def _feature_rows(spark, d):
    k = F.col("p_partkey")
    unit = F.concat(F.col("p_brand"), F.when(k % 7 == 0, F.lit("/b")).otherwise(F.lit("")))
    modality = F.when(k % 3 == 0, F.lit("m6a")).when(k % 3 == 1, F.lit("count")).otherwise(F.lit("other"))
    name = N.feature_row(unit, modality, F.lit("methylated"), F.when(k % 2 == 0, F.lit("site1")))
    p = table(spark, d, "part").select(k.alias("row_id"), name.alias("name")).withColumn("p", N.parse_feature_row(F.col("name")))
    return p.select("row_id", "name", "p.unit", "p.modality", "p.subunit", "p.channel")


@register("names_individuals", """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_name || '@' || c_mktsegment END AS name FROM customer)
SELECT c_custkey, name, CASE WHEN contains(name, '@') THEN string_split(name, '@')[-1] ELSE 'all' END AS individual, string_split(name || '.1', '.')[1] AS stem FROM n""")
def _individuals(spark, d):
    name = F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat_ws("@", "c_name", "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", name.alias("name")).select("c_custkey", "name", N.individual_of(F.col("name")).alias("individual"), N.parse_ensembl_id(F.concat(F.col("name"), F.lit(".1"))).alias("stem"))
