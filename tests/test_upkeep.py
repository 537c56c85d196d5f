"""Upkeep between two snapshots equals a full run and fetches changed texts only."""
from pyspark.sql import functions as F

from codecensus.plans import upkeep as UP
from codecensus.session import write_table
from codecensus.sources import corpus as src
from corpus_helpers import SF, listing

OLD = {"main.py": "import kafka\n", "a.py": "x = 1\n", "gone.py": "y\n", "package.json": '{"dependencies":{"react":"1"}}', "b/same.js": "// c\n"}
NEW = {"main.py": "import kafka\n", "a.py": "x = 1\n# two\n", "new.go": "// n\n", "package.json": '{"dependencies":{"react":"1","jest":"2"}}',
       "b/same.js": "// c\n"}


def _snapshot(spark, texts, repos, stars=1):
    rows = None
    for repo, files in texts.items():
        part = listing(spark, [(p, len(t)) for p, t in files.items()], repo=repo, with_content=files)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("sha", F.sha1("content"))
    records = src.repos(spark, SF).limit(1).drop("repo").crossJoin(
        spark.createDataFrame([(r, s) for r, s in repos.items()], "repo string, own int")).withColumn("stars", F.col("own")).drop("own")
    return UP.Snapshot(rows.drop("content"), write_table(records, "repos")), rows


def _run(spark, old, new, old_repos, new_repos):
    before, old_rows = _snapshot(spark, old, old_repos)
    after, new_rows = _snapshot(spark, new, new_repos)
    texts = {(r.repo, r.path, r.sha): r.content for r in old_rows.unionByName(new_rows).collect()}
    asked = []

    def fetch(keys):
        found = [(k.repo, k.path, k.nth, texts[k.repo, k.path, k.sha]) for k in keys.collect()]
        asked.append({(repo, path) for repo, path, _, _ in found})
        return spark.createDataFrame(found, "repo string, path string, nth int, content string")

    first = UP.first_run(before, fetch, write_table)
    first = UP.Results(first.features, write_table(first.totals, "totals"), write_table(first.report, "report"))
    got = UP.refresh(first, before, after, fetch, write_table)
    asked_for = asked[1]
    return got, UP.first_run(after, fetch, write_table), asked_for


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def _equal(got, full):
    for part in ("features", "totals", "report"):
        a, b = getattr(got, part), getattr(full, part)
        assert _rows(a) == _rows(b), part


def test_refresh_equals_a_full_run(spark):
    same = {"README.md": "# r", "lib/x.py": "pass\n"}
    moved = dict(reversed(OLD.items()))
    got, full, asked = _run(
        spark, {"r1": OLD, "same": same, "dead": same, "order": OLD, "record": same, "emptied": OLD},
        {"r1": NEW, "same": same, "born": NEW, "order": moved, "record": same, "emptied": {"x.py": "1\n"}},
        {"r1": 1, "same": 1, "dead": 1, "order": 1, "record": 1, "emptied": 1},
        {"r1": 1, "same": 1, "born": 2, "order": 1, "record": 2, "emptied": 1})
    _equal(got, full)
    assert asked == ({("r1", p) for p in ("a.py", "new.go", "package.json")} | {("born", p) for p in NEW} | {("emptied", "x.py")})


def test_delta_tells_every_file_and_repeated_paths(spark):
    def rows(spec):
        return spark.createDataFrame([("r", i, p, "file", 1, s) for i, (p, s) in enumerate(spec)],
                                     "repo string, file_seq bigint, path string, type string, size bigint, sha string")

    before = rows([("a", "1"), ("b", "1"), ("twice", "1"), ("twice", "2"), ("c", "1"), ("n", None)])
    after = rows([("a", "1"), ("b", "2"), ("twice", "1"), ("twice", "3"), ("d", "1"), ("n", None)])
    got = {(r.path, r.nth): r.status for r in UP.listing_delta(before, after).collect()}
    assert got == {("a", 1): "kept", ("b", 1): "changed", ("twice", 1): "kept", ("twice", 2): "changed", ("c", 1): "removed",
                   ("d", 1): "added", ("n", 1): "kept"}


def test_blob_store_reads_only_asked_folders(spark, tmp_path):
    texts = spark.range(500).select(F.sha1(F.col("id").cast("string")).alias("sha"), F.col("id").cast("string").alias("content"))
    path = str(tmp_path / "blobs")
    UP.write_blobs(texts, path)
    keys = write_table(texts.where("content = '7'").select(F.lit("r").alias("repo"), F.lit("p").alias("path"), F.lit(1).alias("nth"), "sha"), "keys")
    got = UP.fetch_blobs(path)(keys.where("sha is not null"))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.content for r in got.collect()] == ["7"]


def test_blob_store_takes_texts_that_it_lacks_and_moves_asked_ones(spark, tmp_path):
    def texts(a, b):
        ids = spark.range(a, b).select(F.col("id").cast("string").alias("content"))
        twice = ids.unionByName(ids).unionByName(spark.createDataFrame([(None,)], "content string"))
        return twice.select(F.sha1("content").alias("sha"), "content")

    path = str(tmp_path / "blobs")
    UP.write_blobs(texts(0, 60), path)
    UP.write_blobs(texts(30, 100), path, texts(0, 60))
    UP.write_blobs(texts(0, 100), path, texts(0, 100))  # nothing is lacking
    stored = spark.read.schema("sha string, content string").parquet(path).where("sha IS NOT NULL")
    assert sorted(int(r.content) for r in stored.collect()) == list(range(100))
    keys = write_table(texts(0, 40).where("sha IS NOT NULL").distinct().select(
        F.lit("r").alias("repo"), F.concat(F.lit("p"), "content").alias("path"), F.lit(1).alias("nth"), "sha"), "keys")
    got = UP.fetch_blobs(path)(keys)
    assert sorted((r.path, r.content) for r in got.collect()) == sorted((f"p{i}", str(i)) for i in range(40))
    # texts meet a bitmap of the asked keys before they are shuffled
    assert "bitmap_construct_agg" in got._jdf.queryExecution().optimizedPlan().toString()
