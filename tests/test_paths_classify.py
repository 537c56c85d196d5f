"""§2.2: path projections, filter, priority, categories (reference unit tests A1, A2, A9, A10)."""
from pathlib import PurePosixPath

from codecensus.functions.paths import directory_of, name_of, parent_name_of, suffix_of
from codecensus.operators import classify as C
from codecensus.operators import structure as S
from corpus_helpers import listing

PROBES = [".gitignore", "file.", "x.tar.gz", "a.b/c", "..x", "src/Main.PY", "README", "a/b/c.d.e"]


def test_suffix_name_directory_match_pathlib(spark):
    df = spark.createDataFrame([(p,) for p in PROBES], "path string")
    got = df.select("path", suffix_of("path").alias("s"), name_of("path").alias("n"),
                    directory_of("path").alias("d"), parent_name_of("path").alias("p")).collect()
    for r in got:
        pp = PurePosixPath(r.path)
        assert r.s == pp.suffix.lower(), r.path
        assert r.n == pp.name
        assert r.d == (str(pp.parent) if str(pp.parent) != "." else "root")
        assert r.p == pp.parent.name


def test_structure_totals_and_categories_a1_a2(spark):
    files = listing(spark, [("main.py", 1500), ("src/utils.js", 800), ("README.md", 1200),
                            ("tests/test_main.py", 600), ("package.json", 400)])
    t = S.structure_totals(files).collect()[0]
    assert (t.total_files, t.total_size) == (5, 4500)
    cf = {(r.category, r.path) for r in S.category_files(files).collect()}
    assert ("documentation", "README.md") in cf
    assert ("test", "tests/test_main.py") in cf
    assert ("config", "package.json") in cf
    files2 = listing(spark, [("package.json", 1), ("README.md", 1), ("test_utils.py", 1),
                             ("webpack.config.js", 1), ("main.py", 1)])
    flags = {r.path: r for r in C.classify_files(files2).collect()}
    assert flags["package.json"].is_config
    assert flags["README.md"].is_documentation
    assert flags["test_utils.py"].is_test
    assert flags["webpack.config.js"].is_build
    assert flags["main.py"].is_source


def test_filter_files_a9(spark):
    files = listing(spark, [("main.py", 10), ("__pycache__/test.pyc", 10), ("node_modules/package/index.js", 10),
                            ("large_file.txt", 2 * 1024 * 1024), (".gitignore", 10), ("test.py", 10)])
    kept = [r.path for r in C.filter_files(files, max_size=1 << 20).orderBy("file_seq").collect()]
    assert kept == ["main.py", ".gitignore", "test.py"]


def test_priority_a10(spark):
    files = listing(spark, [("src/utils.py", 1), ("README.md", 1), ("package.json", 1),
                            ("deep/nested/file.py", 1), ("test_file.py", 1)])
    scored = {r.path: r.priority for r in C.with_priority_score(files).collect()}
    assert scored["README.md"] == 140 and scored["package.json"] == 125
    top = C.limit_files(files, max_files=2).orderBy("rank").collect()
    assert [r.path for r in top] == ["README.md", "package.json"]


def test_limit_files_ranks_every_file(spark):
    files = listing(spark, [(f"d/f{i}.py", 1) for i in range(700)] + [("README.md", 1)])
    out = C.limit_files(files).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 702))
    assert [r.path for r in out] == ["README.md"] + [f"d/f{i}.py" for i in range(700)]
    assert C.filter_files(listing(spark, [("big.py", 1 << 40)])).count() == 1


def test_category_flags_independent_of_partitioning(spark):
    files = listing(spark, [(f"d{i % 7}/f{i}.py", i) for i in range(200)] + [("README.md", 3)])
    a = sorted(map(tuple, S.category_counts(files).collect()))
    b = sorted(map(tuple, S.category_counts(files.repartition(13)).collect()))
    assert a == b


def test_language_distribution_share(spark):
    files = listing(spark, [("a.py", 1), ("b.py", 1), ("c.js", 1), ("d.txt", 1)])
    got = {r.language: (r.files, round(r.pct, 3), r.bar_len) for r in S.language_distribution(files).collect()}
    assert got == {"Python": (2, 66.667, 13), "JavaScript": (1, 33.333, 6)}


def _ranked(spark, rows, lanes):
    from pyspark.sql import functions as F
    from codecensus.functions.ranks import gapless_rank, lane_of, splitters
    df = spark.createDataFrame(rows, "repo string, path string").repartition(7)
    got = gapless_rank(df, ["repo"], F.col("path"), count="n", lanes=lanes)
    cut = df.join(splitters(df, ["repo"], F.col("path"), lanes), "repo", "left").withColumn("lane", lane_of(F.col("_cuts"), F.col("path")))
    return [tuple(r) for r in got.select("repo", "path", "rank", "n").collect()], cut.groupBy("repo", "lane").count().collect()


def test_ranks_are_exact_and_lanes_even_under_one_prefix(spark):
    import random
    rng = random.Random(3)
    hot = [("hot", f"src/main/java/com/example/service/module/{rng.randrange(10**9):09d}/File.java") for _ in range(20_000)]
    small = [("small", p) for p in ("b", "a", "a", None)]
    ranks, lanes = _ranked(spark, hot + small, 64)
    sizes = {r.lane: r["count"] for r in lanes if r.repo == "hot"}
    assert len(sizes) == 64 and max(sizes.values()) < 4 * len(hot) / 64
    assert [r["count"] for r in lanes if r.repo == "small"] == [4]
    for repo, rows in (("hot", hot), ("small", small)):
        own = sorted((r for r in ranks if r[0] == repo), key=lambda r: r[2])
        assert [r[2] for r in own] == list(range(1, len(rows) + 1)) and {r[3] for r in own} == {len(rows)}
        assert [r[1] for r in own] == sorted((p for _, p in rows), key=lambda p: (p is not None, p or ""))


def test_ranks_where_a_third_of_the_keys_are_equal(spark):
    rows = [("r", "same")] * 3000 + [("r", f"p{i:05d}") for i in range(6000)]
    ranks, _ = _ranked(spark, rows, 32)
    assert sorted(r[2] for r in ranks) == list(range(1, 9001))
    assert [r[1] for r in sorted(ranks, key=lambda r: r[2])] == sorted(p for _, p in rows)
