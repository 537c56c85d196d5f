"""Incremental runs agree with the batch operators."""
from codecensus.operators.metrics import code_metrics_totals, file_metrics
from codecensus.sources import corpus as src
from codecensus.streaming import latest_totals, stream_file_metrics, stream_repo_metric_totals
from corpus_helpers import SF


def test_stream_matches_batch(spark, tmp_path):
    c = src.contents(spark, SF)
    land = str(tmp_path / "landing")
    c.where("file_seq < 100").write.parquet(land + "/a")
    c.where("file_seq >= 100").write.parquet(land + "/b")
    out, tot = str(tmp_path / "fm"), str(tmp_path / "tot")
    q1 = stream_file_metrics(spark, land + "/*", out, checkpoint=str(tmp_path / "ck1"))
    q1.awaitTermination(300)
    q2 = stream_repo_metric_totals(spark, land + "/*", tot, checkpoint=str(tmp_path / "ck2"))
    q2.awaitTermination(300)
    batch = file_metrics(c)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
    want = {r.repo: r.total_lines for r in code_metrics_totals(batch).collect()}
    got = {r.repo: r.total_lines for r in latest_totals(spark, tot).collect()}
    assert got == want
