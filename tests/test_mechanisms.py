"""Large files by pieces, key filters, mergeable distinct counts and streams
whose files land again."""
import random

from pyspark.sql import functions as F

from codecensus.functions.key_filter import matching, may_match
from codecensus.operators import distinct_bitmaps as DB
from codecensus.operators.metrics import code_metrics_totals, file_metrics
from codecensus.operators.pieces import MARK, file_metrics_by_pieces
from codecensus.streaming.replaced import replaced_totals, stream_replaced_totals
from corpus_helpers import contents


def _random_files(n, seed):
    rng = random.Random(seed)
    parts = ["\n", "\n", " ", "  ", "\t", "#", "//", "/", "<!--", "<!", "--", "x", "code = 1", " ", " ", "é", "😀", "/*", "*", '"""', "%", ";", "'"]
    ends = [".py", ".js", ".html", ".sql", ".css", ".rb", ".java", ".hs", ".tex", ".lua", ".vim", ".txt"]
    return {f"f{i}{rng.choice(ends)}": "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for i in range(n)}


def _rows(df):
    return sorted(map(tuple, df.select("path", "lines", "blank_lines", "comment_lines", "code_lines", "max_indentation").collect()))


def test_pieces_give_the_metrics_of_whole_files(spark):
    files = _random_files(300, 1) | {"long.py": " " * 5000 + "# far", "one.py": "x" * 4000, "blank.py": "\n" * 900, "end.js": "a\n", "ws.py": " \n" * 700 + "\t" * 800}
    df = contents(spark, files).cache()
    want = _rows(file_metrics(df))
    for piece in (1, 2, 3, MARK, 7, 64, 1 << 20):
        assert _rows(file_metrics_by_pieces(df, piece)) == want, piece


def test_no_text_is_shuffled_for_pieces(spark):
    plan = file_metrics_by_pieces(contents(spark, {"a.py": "x"}), 10)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "content" not in line and "text" not in line


def test_key_filter_moves_matches_only(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 7).cast("string").alias("repo"), F.concat(F.lit("p"), F.col("id")).alias("path"),
                                    F.repeat(F.lit("x"), 50).alias("content"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    keys = rows.where("path IN ('p3', 'p77', 'p3999')").select("repo", "path").unionByName(
        spark.createDataFrame([("0", "absent"), ("3", "p3"), (None, "n")], "repo string, path string"))
    got = matching(rows, keys, ["repo", "path"])
    assert sorted(r.path for r in got.collect()) == ["p3", "p3999", "p77"]
    assert may_match(rows, keys, ["repo", "path"]).count() <= 6
    few = may_match(rows, keys, ["repo", "path"], bits=1 << 16)
    assert {"p3", "p77", "p3999"} <= {r.path for r in few.collect()} and few.count() < 100
    assert may_match(rows, keys.limit(0), ["repo", "path"]).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching(rows, keys, ["repo", "path"])._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scan = next(i for i, line in enumerate(plan) if "ReadSchema" in line and "content:string" in line)
    above = [line for i, line in enumerate(plan[:scan]) if depth(line) < depth(plan[scan]) and all(depth(x) > depth(line) for x in plan[i + 1:scan + 1])]
    moved = [i for i, line in enumerate(above) if "Exchange hashpartitioning" in line]
    tested = [i for i, line in enumerate(above) if "BroadcastHashJoin" in line]
    assert moved and tested and min(tested) > max(moved)  # the bit is tested below every exchange of the text


def test_distinct_counts_merge_over_days(spark):
    rng = random.Random(2)
    days = [[("r%d" % rng.randrange(3), rng.choice(["dependencies", "code_patterns"]), f"v{rng.randrange(120 * (d + 1))}") for _ in range(600)]
            for d in range(3)]
    days[1] += [("r0", "dependencies", None), ("new", "dependencies", "only")]
    by, known, maps = ["repo", "field"], None, []
    for rows in days:
        df = spark.createDataFrame(rows, "repo string, field string, value string")
        known = DB.grown_dictionary(df, by, known=known).cache()
        maps.append(DB.value_bitmaps(df, known, by).cache())
    ids = {}
    for r in known.collect():
        ids.setdefault((r.repo, r.field), []).append(r.id)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ids.values())
    for chosen in ([0], [1, 2], [0, 1, 2]):
        df = maps[chosen[0]]
        for d in chosen[1:]:
            df = df.unionByName(maps[d])
        want = {}
        for d in chosen:
            for repo, field, value in days[d]:
                if value is not None:
                    want.setdefault((repo, field), set()).add(value)
        assert {(r.repo, r.field): r.n for r in DB.distinct_counts(df, by).collect()} == {k: len(v) for k, v in want.items()}


def test_more_values_than_a_bitmap_holds(spark):
    df = spark.range(70_000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("value"))
    known = DB.grown_dictionary(df, ["repo"]).cache()
    maps = DB.value_bitmaps(df, known, ["repo"])
    assert maps.count() == 3 and DB.distinct_counts(maps.unionByName(maps), ["repo"]).collect()[0].n == 70_000


def test_files_that_land_again_replace_their_counts(spark, tmp_path):
    land, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    now = {}
    for k, files in enumerate([{"a.py": "x\n# c\n", "b.js": "// y\n", "n.txt": "?"}, {"a.py": "x\n", "c.py": "1\n2\n\n"}, {"b.js": "", "a.py": "x\n"},
                               {"c.py": "1\n", "n.txt": "other"}]):
        now |= files
        contents(spark, files).coalesce(1).write.parquet(f"{land}/l{k}")
        stream_replaced_totals(spark, land + "/*", out, check).awaitTermination(300)
        got = sorted(map(tuple, replaced_totals(spark, out).collect()))
        want = code_metrics_totals(file_metrics(contents(spark, now)))
        assert got == sorted(map(tuple, want.select(*replaced_totals(spark, out).columns).collect())), k


def test_top_values_equal_a_full_count_and_rare_ones_stay(spark, tmp_path):
    from pyspark.sql import Window

    from codecensus.operators import top_values as TV
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        repo = rng.choice(["hot", "hot", "hot", "mid", "few"])
        value = f"v{min(int(rng.paretovariate(0.7)), 900)}" if rng.random() < 0.6 else f"rare{rng.randrange(10**6)}"
        rows.append((repo, None if i % 97 == 0 else value, i // 3, i % 3))
    rows += [("tie", v, 7000 + k, 0) for k, v in enumerate(["b", "a", "c", "a", "b", "c", "d"])] + [("one", "x", 9000, 0)]
    df = spark.createDataFrame(rows, "repo string, value string, file_seq long, pos int").repartition(9)
    agg = df.where("value IS NOT NULL").groupBy("repo", "value").agg(F.count("*").alias("n"), F.min(F.struct("file_seq", "pos")).alias("first"))
    for n, held in ((1, 10**6), (3, 10**6), (10, 50), (10, 10**6)):
        path = str(tmp_path / f"p{n}-{held}")
        TV.partial_counts(df, ["repo"], n, held).write.parquet(path)
        partial = spark.read.parquet(path)
        ranked = agg.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= n)
        want = sorted((r.repo, r["rank"], r.value, r.n) for r in ranked.collect())
        assert sorted(map(tuple, TV.top_values(partial, ["repo"], n).collect())) == want
    moved = TV.candidates(partial, ["repo"], 10)
    assert not [r for r in moved.where("repo = 'hot'").collect() if r.value.startswith("rare")]
    assert moved.where("repo = 'hot'").count() < 0.1 * agg.where("repo = 'hot'").count()


def test_top_values_of_nothing(spark):
    from codecensus.operators import top_values as TV
    none = spark.createDataFrame([], "repo string, value string, file_seq long, pos int")
    assert TV.top_values(TV.partial_counts(none, ["repo"], 5), ["repo"], 5).count() == 0
