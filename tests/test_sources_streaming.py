from pyspark.sql import functions as F

from lattica.matrix import Matrix, part_by_order
from lattica.operators.intervals import overlap_join
from lattica.operators.stats import row_stats
from lattica.sources import text
from lattica.streaming import running


def test_mtx_round_trip(spark, sf, tmp_path):
    cells = part_by_order(spark, sf).cells.where("row_id < 40")
    m = Matrix(cells, spark.range(40).toDF("row_id"), spark.range(1500).toDF("col_id"))
    text.write_mtx(m, str(tmp_path / "m"))
    lines = [r.value for p in ("header", "cells") for r in spark.read.text(str(tmp_path / "m" / p)).collect()]
    (tmp_path / "one.mtx").write_text("\n".join([*lines, "not a triplet", "7 x 1", "3"]))
    assert sorted(map(tuple, text.read_mtx(spark, str(tmp_path / "one.mtx")).collect())) == sorted(map(tuple, cells.select("row_id", "col_id", "val").collect()))


def test_fragments_over_peaks(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("# x\nchr1\t10\t20\tBC_A\t1\n1\t15\t30\tBC_A\t2\nChr1\t100\t110\tBC_B\n2\t5\t9\tBC_C\t1\n2\t9\t9\tBC_C\t1\n2\t-5\t9\tBC_C\t1\n")
    (tmp_path / "p.bed").write_text("chr1\t0\t25\nchr1\t105\t200\nchr2\t0\t6\n")
    f, p = text.read_fragments(spark, str(tmp_path / "f.tsv")), text.read_bed(spark, str(tmp_path / "p.bed"))
    found = overlap_join(f, p, "chr", 10).groupBy("r_start", "barcode").agg(F.sum("cnt").alias("n"))
    assert sorted(map(tuple, found.collect())) == [(0, "BC_A", 3), (0, "BC_C", 1), (105, "BC_B", 1)]


def test_gff_gmt_names(spark, tmp_path):
    (tmp_path / "g.gff").write_text('#c\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "G1.2"; gene_name "N"; transcript_id "T"\n')
    r = text.read_gff(spark, str(tmp_path / "g.gff")).first()
    assert (r.feature, r.start, r.stop, r.strand, r.gene_id, r.gene_name, r.gene_type, r.transcript_id) == ("exon", 10, 20, "+", "G1.2", "N", None, "T")
    (tmp_path / "s.gmt").write_text("# sets\tx\ty\nt1\td\ta\tb\tB \nt2\td\tc\n")
    assert sorted(map(tuple, text.read_gmt(spark, str(tmp_path / "s.gmt")).collect())) == [("t1", "A"), ("t1", "B"), ("t2", "C")]
    (tmp_path / "n.tsv").write_text("E1\tA\nE2\nE3\tE3\n")
    assert [r.name for r in text.read_names(spark, str(tmp_path / "n.tsv"), True).orderBy("id").collect()] == ["E1_A", "E2", "E3"]


def test_running_stats_equal_batch(spark, sf, tmp_path):
    m = part_by_order(spark, sf)
    m.cells.write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(m.cells.schema).parquet(str(tmp_path / "cells"))
    found = running.drain(running.running_row_stats(stream, m.n_cols), "running_rows", "complete")
    assert sorted((r.row_id, r.nnz, r.tot, round(r.sig, 9)) for r in found.collect()) == sorted((r.row_id, r.nnz, r.tot, round(r.sig, 9)) for r in row_stats(m).where("tot > 0").collect())


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    found = running.drain(running.windowed_counts(stream, "1 hour", "1 day"), "hours", "complete")
    assert sum(r.n for r in found.collect()) == events.count()
