"""Driver contract, plan shape checks and sinks."""
import os

import __spark_entry__ as E
from codecensus.plans import queries as Q
from codecensus.sources import sinks
from corpus_helpers import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 90


def test_no_python_udf_in_any_plan(spark):
    for name, fn in Q.REGISTRY.items():
        p = _plan(fn(spark, SF))
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name


def test_quick_mode_reads_no_text(spark):
    p = Q.REGISTRY["analyze_quick"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in p and "text" not in p.split("ReadSchema")[1].split("\n")[0]


def test_top_n_uses_window_group_limit(spark):
    p = _plan(Q.REGISTRY["largest_files"](spark, SF))
    assert "WindowGroupLimit" in p


def _documents(rows):
    docs = {}
    for r in sorted(rows, key=lambda r: (r.repo, r.section, r.part, r.ord)):
        docs[r.repo] = docs.get(r.repo, "") + r.text
    return docs


def test_full_report_renders_every_section(spark):
    docs = _documents(Q.REGISTRY["analyze_full"](spark, SF).collect())
    assert docs
    for head in ("## 📁 Project Structure", "## 📦 Dependencies", "## 📊 Code Metrics",
                 "## 📚 Documentation Quality", "## 💡 Recommendations"):
        assert all(head in doc for doc in docs.values())


def _many(spark, n):
    """One repository of n code files with replies; files late in the
    listing score higher."""
    from pyspark.sql import functions as F
    i = F.col("id")
    path = F.concat(F.when(i % 100 == 99, F.lit("core/engine_")).otherwise(F.lit("lib/f")), i.cast("string"), F.lit(".py"))
    rows = spark.range(n).select(
        F.lit("r1").alias("repo"), i.alias("file_seq"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"),
        F.lit("file").alias("type"), F.lit(10).cast("bigint").alias("size"),
        F.concat(F.repeat(F.lit("x = 1\n"), 600), i.cast("string")).alias("content"))
    n_ = F.col("file_seq").cast("string")
    replies = rows.select("repo", "path", "file_seq", F.concat(
        F.lit('{"complexity_assessment":"C'), n_, F.lit(' x","code_patterns":["P'), n_,
        F.lit('"]}')).alias("response"), F.lit(None).cast("string").alias("error"))
    repos = spark.createDataFrame([("r1",)], "repo string")
    from codecensus.sources import corpus as src
    full = src.repos(spark, SF).limit(1).withColumn("repo", F.lit("r1"))
    return rows, replies, full.join(repos, "repo")


def test_every_file_is_analysed(spark):
    from codecensus.operators import reports as RP
    from codecensus.plans import features as FT
    from codecensus.plans import modes as MD
    from codecensus.operators import metrics as M
    from codecensus.operators import structure as S
    listing, _, repos = _many(spark, 620)
    feats = MD.relevant_features(listing).cache()
    assert feats.count() == 620
    fm = FT.metrics_from(feats)
    langs = S.language_counts(feats).select("repo", "language", "first_seq")
    text = _documents(RP.report_fragments([RP.metrics_section(
        RP.fm_stats(fm), M.code_metrics_by_language(fm), langs, fm, repos)]).collect())["r1"]
    assert text.count(" lines)\n") == 620  # every large file has its line


def test_explanations_follow_the_selection(spark):
    """The order of insights is that of the selection, not of the listing."""
    from codecensus.operators import explanations as X
    from codecensus.operators import ranking as K
    from codecensus.plans import modes as MD
    listing, replies, repos = _many(spark, 300)
    feats = MD.relevant_features(listing)
    keys = K.key_files_from(feats).select("repo", "path")
    selected = [r.path for r in K.select_from_features(feats, keys).orderBy("rank").collect()]
    expl = MD.selected_explanations(feats, replies)
    assert [r.path for r in expl.orderBy("file_seq").collect()] == selected
    assert selected != sorted(selected, key=lambda p: int("".join(c for c in p if c.isdigit())))
    words = [r.value for r in X.insights_summary(expl).where("section = 'complexity'").orderBy("pos").collect()]
    assert words == ["C" + "".join(c for c in p if c.isdigit()) for p in selected]


def test_sinks(spark, tmp_path):
    q = Q.REGISTRY["analyze_quick"](spark, SF)
    out = str(tmp_path / "reports")
    sinks.write_reports(q.withColumnRenamed("document", "report"), out)
    parts = [os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.startswith("part-")]
    assert len(parts) >= q.count()
    j = str(tmp_path / "json")
    sinks.write_results_json(Q.REGISTRY["insights_summary"](spark, SF), j)
    assert spark.read.json(j).count() == Q.REGISTRY["insights_summary"](spark, SF).count()


def test_fragments_written_in_order(spark, tmp_path):
    frags = Q.REGISTRY["render_report"](spark, SF).cache()
    docs = _documents(frags.collect())
    out = str(tmp_path / "docs")
    sinks.write_reports(frags, out)
    for repo, doc in docs.items():
        d = os.path.join(out, f"repo={repo}", "doc=report")
        text = "".join(open(os.path.join(d, f), encoding="utf-8").read()
                       for f in sorted(os.listdir(d)) if f.startswith("part-"))
        assert text == doc + "\n"


def test_report_reads_no_text_after_the_feature_pass(spark):
    for name in ("technology_stack", "render_report", "analyze_full"):
        schemas = [x for x in _plan(Q.REGISTRY[name](spark, SF)).split("\n") if "ReadSchema" in x]
        assert schemas and not any("text:string" in x or "content:string" in x for x in schemas), name


def test_landed_tree_is_listed_in_path_order(spark, tmp_path):
    from codecensus.sources.readers import read_listing
    for p in ("r1/b.py", "r1/a/z.py", "r1/a.py", "r2/x.md"):
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    rows = read_listing(spark, str(tmp_path / "tree"), "binaryFile").orderBy("repo", "file_seq").collect()
    assert [(r.repo, r.path, r.name) for r in rows] == [
        ("r1", "a.py", "a.py"), ("r1", "a/z.py", "z.py"), ("r1", "b.py", "b.py"), ("r2", "x.md", "x.md")]
