"""Text sources and sinks: MatrixMarket, name lists, fragments, BED, GFF, GMT; Spark's own readers do the splitting and scheduling of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, val) from MatrixMarket triplets, numbered from 0. Comment lines go, and with them the one size line of three counts, known by its file position being the first; so do lines that are no triplet."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min("at").alias("at"))
    f = F.split(F.trim("value"), r"\s+")
    return lines.join(F.broadcast(first), ["file", "at"], "left_anti").select((F.get(f, F.lit(0)).try_cast("long") - 1).alias("row_id"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("col_id"), F.get(f, F.lit(2)).try_cast("double").alias("val")).na.drop()


def read_names(spark: SparkSession, path: str, id_name: bool = False) -> DataFrame:
    """(id, name) of a one-file list in line order from 0; with id_name the first two fields become id_name."""
    from pyspark.sql import Window

    from ..functions.names import compose_id_name

    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    f = F.split("value", "\t")
    name = compose_id_name(f[0], F.get(f, F.lit(1))) if id_name else f[0]
    return lines.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("id"), name.alias("name"))


def read_mtx_matrix(spark: SparkSession, matrix: str, features: str, samples: str) -> Matrix:
    """A matrix from a MatrixMarket file and its two name lists."""
    f, s = read_names(spark, features, id_name=True), read_names(spark, samples)
    return Matrix(read_mtx(spark, matrix), f.toDF("row_id", "name"), s.toDF("col_id", "name"))


def write_mtx(m: Matrix, path: str) -> None:
    """Writes triplets, numbered from 1, in column order, as text parts below path, after a part with the header."""
    spark = m.cells.sparkSession
    n = m.cells.count()
    spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{m.n_rows} {m.n_cols} {n}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    m.cells.orderBy("col_id", "row_id").select(F.concat_ws(" ", F.col("row_id") + 1, F.col("col_id") + 1, F.col("val"))).write.mode("overwrite").text(f"{path}/cells")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, barcode, cnt): comments, empty intervals and negative starts go, chr is stripped in any letter case, a missing count is 1."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 4))
    rows = rows.select(F.regexp_replace(f[0], "^(?i)chr", "").alias("chr"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), f[3].alias("barcode"), F.coalesce(F.get(f, F.lit(4)).try_cast("long"), F.lit(1)).alias("cnt"))
    return rows.where("start >= 0 AND end > start")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", r"\s+")
    return spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.size(f) >= 3)).select(F.regexp_replace(f[0], "^(?i)chr", "").alias("chr"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene), one row per member, genes trimmed and in upper case; comment lines go."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 3))
    return rows.select(F.trim(f[0]).alias("term"), F.explode(F.slice(f, 3, F.size(f))).alias("gene")).select("term", F.upper(F.trim("gene")).alias("gene")).where("term <> '' AND gene <> ''").distinct()


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """seqname, feature, start, stop (1-based, closed), strand, and the gene_id, gene_name, gene_type and transcript_id attributes."""
    f = F.split("value", "\t")
    attribute = lambda k: F.nullif(F.regexp_extract(f[8], rf'(?:^|;\s*){k}[ =]"?([^";]+)', 1), F.lit(""))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    return rows.select(f[0].alias("seqname"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("stop"), f[6].alias("strand"), *(attribute(k).alias(k) for k in ("gene_id", "gene_name", "gene_type", "transcript_id")))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms (id, name), edges (parent, child, relation)) of an OBO ontology: is_a and part_of between terms that are there and not obsolete.

    Records are stanzas, so files of any length are split among tasks; what follows ! or stands in braces at a line's end is no value.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    lines = F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, r"\s*![^\n]*$", ""), r"\s*\{[^}]*\}\s*$", "")))
    of = lambda key: F.transform(F.filter("lines", lambda l: l.startswith(key)), lambda l: F.trim(F.substring(l, len(key) + 1, 10_000)))
    found = stanzas.select(lines.alias("lines")).select(F.get(of("id:"), F.lit(0)).alias("id"), F.get(of("name:"), F.lit(0)).alias("name"), of("is_a:").alias("is_a"), of("relationship: part_of").alias("part_of"), F.exists(of("is_obsolete:"), lambda x: F.lower(x) == "true").alias("obsolete"))
    found = found.where("id IS NOT NULL AND NOT obsolete")
    terms = found.select("id", "name")
    edges = found.select(F.col("id").alias("child"), F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.col(r).alias("parents")) for r in ("is_a", "part_of")))).alias("e"))
    edges = edges.select("child", F.explode("e.parents").alias("parent"), F.col("e.relation").alias("relation"))
    return terms, edges.join(terms.select(F.col("id").alias("parent")).distinct(), "parent").select("parent", "child", "relation").distinct()
