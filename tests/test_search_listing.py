"""Code search through the index, and listings from Python data sources."""
import json
import random

import pytest
from pyspark.sql import functions as F

from codecensus.sources import activity as A
from codecensus.sources import readers as R
from codecensus.sources import search_index as SI


def _texts(spark, rows):
    return spark.createDataFrame(rows, "repo string, file_seq bigint, path string, content string")


def _corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma_ray", "naïve", "İstanbul", "kafka", "日本語", "x"]
    return [(f"org{i % 2}/r{i % 3}", i, f"p{i}.py", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(n)]


def _found(df):
    return sorted((r.repo, r.path, r.file_seq) for r in df.collect())


@pytest.mark.parametrize("pushed", [1000, 0])
def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(SI, "PUSHED_BLOCKS", pushed)
    monkeypatch.setattr(SI, "PIECE", 7)  # grams across pieces
    rows = [*_corpus(150), ("org0/r0", 900, "n.py", None), ("org0/r0", 901, "e.py", ""), ("org1/r9", 70_000, "far.py", "only here: Kafka")]
    index = SI.Index(str(tmp_path / "index"), 4, 8)
    SI.add_to_index(index, 0, _texts(spark, rows))
    for text in ("kafka", "KAFKA", "a_r", "naïve", "日本語", "ph", "nothing such", "beta gamma_ray", "only here"):
        assert _found(SI.search_index(spark, index, text)) == _found(A.search_code(_texts(spark, rows), text)), text
    for owner, repo in (("org1", None), ("org0", "r0"), (None, "org1/r1")):
        assert _found(SI.search_index(spark, index, "kafka", owner, repo)) == _found(A.search_code(_texts(spark, rows), "kafka", owner, repo))


def test_generations_replace_add_and_remove(spark, tmp_path):
    index = SI.Index(str(tmp_path / "index"), 4, 8)
    rows = {seq: (repo, seq, path, text) for repo, seq, path, text in _corpus(40)}
    SI.add_to_index(index, 0, _texts(spark, list(rows.values())))
    new = [("org0/r0", 0, "p0.py", "kafka now"), ("org1/r1", 1, "moved.py", "nothing"), ("org0/r0", 500, "new.py", "a kafka")]
    gone = [(rows[2][0], 2), (rows[3][0], 3)]
    SI.add_to_index(index, 1, _texts(spark, new), spark.createDataFrame(gone, "repo string, file_seq bigint"))
    rows.update({r[1]: r for r in new})
    rows = [r for r in rows.values() if r[1] not in (2, 3)]
    for text in ("kafka", "now", "beta", "x"):
        assert _found(SI.search_index(spark, index, text)) == _found(A.search_code(_texts(spark, rows), text)), text


def test_search_reads_candidate_folders_and_no_other_text(spark, tmp_path):
    index = SI.Index(str(tmp_path / "index"), 16, 32)
    rows = [("o/r", i, f"p{i}", "plain words here") for i in range(64 * 60)] + [("o/r", 64 * 70, "q", "the needle")]
    SI.add_to_index(index, 0, _texts(spark, rows))
    hits = SI.search_index(spark, index, "needle")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x]
    with_text = [x for x in scans if "content" in x.split("ReadSchema")[1]]
    assert len(with_text) == 1 and "folder" in with_text[0].split("PartitionFilters")[1].split("]")[0]
    assert "In(block" in with_text[0] or "EqualTo(block" in with_text[0]
    assert _found(hits) == [("o/r", "q", 64 * 70)]
    assert [(b.repo, b.block) for b in SI.candidate_blocks(spark, index, "needle").collect()] == [("o/r", 70)]


def test_postings_of_scattered_files_come_packed(spark):
    rows = [("o/r", 60 * i - 3000, f"p{i}", "plain words here") for i in range(300)] + [("o/r", 7, "x", "plain"), (None, 8, "y", "plain"), ("o/r", 9, "z", "")]
    got = SI.postings(_texts(spark, rows)).collect()
    files = {}
    for p in got:
        files.setdefault(p.gram, set()).update((p.stretch << SI.PLACE) + place for place in p.places)
    text = "plain words here"
    grams = {text[i:i + 3] for i in range(len(text) - 2)}
    assert files == {g: {60 * i - 3000 for i in range(300)} | ({7} if g in "plain" else set()) for g in grams}
    assert len(got) <= 4 * len(grams)  # stretches -1 and 0, not a row for each file and gram


def test_grams_of_many_groups_and_letters(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(SI, "LETTERS", 4000)
    rows = [(f"r{i}", i >> SI.PLACE, i, "".join(chr(0x4E00 + 5 * i + k) for k in range(5)) + "abab\0\0\0") for i in range(1100)]
    rows += [("s", 0, 1, "ab"), ("s", 0, 2, "ba"), ("s", 0, 3, ""), ("s", 1, 3, "abc\U0010FFFF")]
    batch = pa.RecordBatch.from_pydict({"repo": [r[0] for r in rows], "stretch": [r[1] for r in rows],
                                        "place": pa.array([r[2] for r in rows], pa.int16()), "piece": [r[3] for r in rows]})
    got = sorted((r["repo"], r["stretch"], r["gram"], p) for b in SI._packed([batch.slice(0, 0), batch]) for r in b.to_pylist() for p in r["places"])
    assert got == sorted({(r, s, t[i:i + 3], p) for r, s, p, t in rows for i in range(len(t) - 2)})


PAGES = [("r1", 0, {"value": [{"path": "/a.py", "isFolder": False, "size": 3}, {"path": "/d", "isFolder": True}, {"path": "/e"}]}),
         ("r1", 1, {"value": [{"path": "//b.py", "isFolder": False}]}), ("r2", 0, {"value": []}), ("r2", 1, {"count": 0}),
         ("r3", 5, {"value": [{"path": "/z", "isFolder": False, "size": 9}, "odd", None]})]


def test_listing_pages_with_and_without_filters(spark, tmp_path):
    path = str(tmp_path / "pages")
    raw = [(r, p, json.dumps(j)) for r, p, j in PAGES] + [("r3", 6, "{broken"), ("r3", 7, None)]
    spark.createDataFrame(raw, "repo string, page bigint, json string").repartitionByRange(3, "repo", "page").write.parquet(path)

    def rows(cond, pushdown):
        got = R.read_listing(spark, path, "listing_pages", pushdown=pushdown).where(cond)
        return sorted((r.repo, r.page, r.path, r.size) for r in got.collect())

    every = [("r1", 0, "a.py", 3), ("r1", 1, "b.py", 0), ("r3", 5, "z", 9)]
    for pushdown in (False, True):
        assert rows("true", pushdown) == every
        assert rows("repo = 'r1' AND page >= 1", pushdown) == every[1:2]
        assert rows("repo IN ('r3', 'r9') OR page > 5", pushdown) == every[2:]
        assert rows("page < 0", pushdown) == []
        assert rows("size = 9 AND repo > 'r2'", pushdown) == every[2:]


def test_page_filters_skip_row_groups(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    from codecensus.sources.listing_sources import PushingPagesReader
    table = pa.table({"repo": [f"r{i // 10}" for i in range(40)], "page": list(range(40)), "json": ["{}"] * 40})
    pq.write_table(table, str(tmp_path / "p.parquet"), row_group_size=10)

    def groups(*filters):
        reader = PushingPagesReader(str(tmp_path))
        rest = list(reader.pushFilters(list(filters)))
        return [p.number for p in reader.partitions()], rest

    assert groups()[0] == [0, 1, 2, 3]
    assert groups(EqualTo(("repo",), "r2"))[0] == [2]
    assert groups(In(("repo",), ("r0", "r3")), GreaterThan(("page",), 12))[0] == [3]
    assert groups(IsNotNull(("repo",)))[1] == [IsNotNull(("repo",))]


def test_landed_tree_lists_like_the_binary_files(spark, tmp_path):
    for p in ("r1/b.py", "r1/a/z.py", "r1/a/deep/er/x", "r1/a.py", "r1/.gitignore", "r2/x.md", "loose.txt"):
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    (tmp_path / "tree" / "empty").mkdir()
    got = R.read_listing(spark, str(tmp_path / "tree"), "landed_tree").orderBy("repo", "file_seq").collect()
    assert [(r.repo, r.path, r.name, r.size) for r in got] == [
        ("r1", p, p.rsplit("/", 1)[-1], len(p) + 3) for p in (".gitignore", "a.py", "a/deep/er/x", "a/z.py", "b.py")] + [("r2", "x.md", "x.md", 7)]
    one = R.read_listing(spark, str(tmp_path / "tree"), "landed_tree", repos=["r2"])
    assert [r.path for r in one.collect()] == ["x.md"]
