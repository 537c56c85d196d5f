"""§2.1, §2.7, §2.8: replies (A16), insights (A12), selection (A13), listing
normalisation (A14), activity (A15), organisation repositories (A17),
language bytes (A11) and URL forms."""
import json

from pyspark.sql import functions as F

from codecensus.operators import explanations as X
from codecensus.operators import ranking as K
from codecensus.sources import activity as A
from codecensus.sources import readers as R
from corpus_helpers import contents


def _responses(spark, replies: dict, errors=None):
    rows = [{"repo": "r1", "path": p, "file_seq": i, "response": t, "error": (errors or {}).get(p)}
            for i, (p, t) in enumerate(replies.items())]
    return spark.createDataFrame(rows, "repo string, path string, file_seq bigint, response string, error string")


EXPL = {
    "run.py": dict(summary="Starts the service", main_functionality="Reads settings and opens the port",
                   key_components=["start", "read_settings"], dependencies=["click", "httpx"],
                   complexity_assessment="Low, one branch", improvement_suggestions=["Handle a missing error file", "Split the settings"],
                   code_patterns=["Singleton", "Command"]),
    "lib/routes.py": dict(summary="Routes of the service", main_functionality="Maps paths to handlers",
                          key_components=["routes"], dependencies=["httpx", "jinja2"],
                          complexity_assessment="High because of nesting", improvement_suggestions=["Check inputs", "Write documentation"],
                          code_patterns=["Singleton", "Decorator"]),
}


def test_complexity_distribution_parses_a_reply_once(spark):
    replies = {"a.py": '{"complexity_assessment":"Low. ok"}', "b.py": '{"complexity_assessment":""}', "c.py": '{"complexity_assessment":" x"}',
               "d.py": '{"complexity_assessment":"Low. so"}', "e.py": "no reply", "f.py": '{"complexity_assessment":null}'}
    e = X.parse_responses(_responses(spark, replies))
    counts = X.complexity_distribution(e)
    assert {(r.complexity, r.files, r.first_seq) for r in counts.collect()} == {("Low.", 2, 0), ("", 1, 2), ("Unknown", 2, 4)}

    def parsers(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("from_json")

    assert parsers(counts) <= parsers(e)
    # an assessment that is null (not only absent) is left out
    given = spark.createDataFrame([("r", None, 0), ("r", "Low. x", 1)], "repo string, complexity_assessment string, file_seq bigint")
    assert [tuple(r) for r in X.complexity_distribution(given).collect()] == [("r", "Low.", 1, 1)]


def test_insights_a12(spark):
    e = X.parse_responses(_responses(spark, {p: json.dumps(v) for p, v in EXPL.items()}))
    ins = {}
    for r in X.insights_summary(e).orderBy("section", "pos").collect():
        ins.setdefault(r.section, []).append((r.value, r.n))
    assert ins["files"] == [(None, 2)]
    assert set(ins["complexity"]) == {("Low,", 1), ("High", 1)}
    assert ins["pattern"][0] == ("Singleton", 2)
    assert ins["technology"][0] == ("httpx", 2)
    assert [t for t, _ in ins["theme"]] == ["Error Handling", "Documentation"]


def test_lists_keep_values_with_a_bar(spark):
    e = X.parse_responses(_responses(spark, {"a.py": json.dumps({"code_patterns": ["A|B", "C"]})}))
    rows = X.code_analysis_overview(X.insights_summary(e)).where("section = 'pattern'").orderBy("pos").collect()
    assert [r.value for r in rows] == ["A|B", "C"]
    assert X.explanation_overview(e).collect()[0].top_patterns == ["A|B", "C"]


def test_reply_is_parsed_once(spark):
    plan = X.parse_responses(_responses(spark, {"a.py": "{}"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2


def test_parse_reply_and_fallback_a16(spark):
    sample = ('Sure: {"summary": "Sample", "key_components": ["Response parser", "JSON extraction logic", '
              '"Fallback parsing mechanism"], "improvement_suggestions": [{"text": "Add checks"}, "Add tests"]} end')
    e = X.parse_responses(_responses(spark, {"a.py": sample, "b.py": "This is not valid JSON but should still be parsed",
                                             "c.py": "x"}, errors={"c.py": "timeout"}))
    rows = {r.path: r for r in e.collect()}
    assert rows["a.py"].status == "parsed" and len(rows["a.py"].key_components) == 3
    assert rows["a.py"].main_functionality == "No functionality description provided"
    assert rows["b.py"].summary == "This is not valid JSON but should still be parsed"
    assert rows["b.py"].complexity_assessment == "Unknown"
    assert rows["c.py"].summary == "Analysis failed due to an error"
    items = X.explanation_items(e).where("field = 'improvement_suggestions'").orderBy("pos").collect()
    assert [(i.is_string, i.value) for i in items] == [(False, '{"text":"Add checks"}'), (True, "Add tests")]


def test_issue_candidates_dedupe_and_open_titles(spark):
    e = X.parse_responses(_responses(spark, {
        "a.py": json.dumps({"improvement_suggestions": ["  Add tests ", "x" * 130]}),
        "b.py": json.dumps({"improvement_suggestions": ["add TESTS", {"description": "Use a cache"}]})}))
    items = X.explanation_items(e)
    opened = spark.createDataFrame([("r1", "investigate: testing")], "repo string, title string")
    out = X.issue_candidates(X.improvement_themes(items), items, opened).orderBy("src", "o1", "o2").collect()
    assert [r.title for r in out] == ["Add tests", "x" * 130, "Use a cache"]
    assert [r.title_short for r in out] == ["Add tests", "x" * 117 + "...", "Use a cache"]


def test_issue_candidates_differ_after_200_characters(spark):
    long_ = "y" * 300
    e = X.parse_responses(_responses(spark, {"a.py": json.dumps({"improvement_suggestions": [long_ + "1", long_ + "2"]})}))
    items = X.explanation_items(e)
    assert X.issue_candidates(X.improvement_themes(items), items).count() == 2


def test_selection_a13(spark):
    files = {"main.py": "def main():\n    pass\n", "utils/helper.py": "x = 1\n", "README.md": "# r"}
    c = contents(spark, files)
    focus = spark.createDataFrame([("r1", "main.py")], "repo string, path string")
    for f in (focus, None):
        assert "main.py" in [r.path for r in K.select_for_analysis(c, f).collect()]


def test_key_files_quota_and_extras(spark):
    from corpus_helpers import listing
    paths = ["main.py", "app.py", "server.js", "core_a.py", "core_b.py", "core_c.py", "core_d.py",
             "api_x.py", "z1.py", "z2.go", "README.md"]
    text = {p: "\n".join(["x"] * (100 if p == "z2.go" else 3)) for p in paths}
    lt = listing(spark, [(p, 1) for p in paths], with_content=text)
    got = [(r.kind, r.path) for r in K.key_files(lt).orderBy("pos").collect()]
    assert got[:2] == [("main", "main.py"), ("main", "app.py")]
    assert [p for k, p in got if k == "core"] == ["core_a.py", "core_b.py", "core_c.py"]
    assert ("extra", "z2.go") == got[[k for k, _ in got].index("extra")]


def test_ado_listing_a14(spark):
    raw = spark.createDataFrame([("r1", 0, json.dumps({"value": [
        {"path": "/main.py", "isFolder": False, "size": 1000}, {"path": "/src", "isFolder": True},
        {"path": "/docs"}]}))], "repo string, page bigint, json string")
    files = R.normalize_ado_listing(raw).collect()
    assert [(f.path, f.size) for f in files] == [("main.py", 1000)]
    c = R.listing_counts(raw).collect()[0]
    assert (c.file_count, c.folder_count) == (1, 1)


def test_activity_a15_a17(spark):
    commits = spark.createDataFrame(
        [("r1", "abcdef0123456789", "Initial commit\nbody", "Test Author", "2024-01-01 00:00:00", "u", "main")],
        "repo string, sha string, message string, author string, date string, url string, branch string"
    ).withColumn("date", F.to_timestamp("date"))
    rc = A.recent_commits(commits).collect()[0]
    assert (rc.sha, rc.message, rc.author) == ("abcdef01", "Initial commit", "Test Author")
    prs = spark.createDataFrame([("r1", 123, "Test PR", "active")], "repo string, pr_id bigint, title string, status string")
    pr = A.pull_requests_by_status(prs, "active").collect()[0]
    assert (pr["pr_id"], pr["count"]) == (123, 1)
    projects = spark.createDataFrame([("p1",)], "project string")
    pr_repos = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("gone", "c")], "project string, repo string")
    assert sorted((r["repo"], r["count"]) for r in A.list_org_repositories(projects, pr_repos).collect()) == [("a", 2), ("b", 2)]
    assert [r.repo for r in A.list_org_repositories(projects, pr_repos, "gone").collect()] == ["c"]
    many = spark.range(250).select(F.lit("r1").alias("repo"), F.col("id").alias("pr_id"), F.lit("t").alias("title"),
                                   F.lit("active").alias("status"))
    rows = A.pull_requests_by_status(many, "all").orderBy("rank").collect()
    assert [r.pr_id for r in rows] == list(range(249, -1, -1)) and rows[0]["count"] == 250
    page = A.pull_requests_by_status(many, "all", page=3, per_page=100).orderBy("rank").collect()
    assert [r.pr_id for r in page] == list(range(49, -1, -1))


def test_language_bytes_a11(spark):
    repos = spark.createDataFrame([("test-repo", {"Python": 1000, "JavaScript": 500})],
                                  "repo string, languages map<string,bigint>")
    got = {r.language: round(r.pct, 1) for r in R.language_bytes_share(repos).collect()}
    assert got == {"Python": 66.7, "JavaScript": 33.3}


def test_url_forms(spark):
    urls = spark.createDataFrame([(u,) for u in [
        "https://github.com/o/r", "o/r", "https://github.com/o/widget.git/", "o/r/x", "http://x", "ftp://x",
        "https://dev.azure.com/org/proj/_git/repo", "https://org.visualstudio.com/proj/_git/repo/"]], "url string")
    got = {r.url: r for r in R.parse_repo_url(urls).collect()}
    assert got["o/r"].platform == "github" and got["o/r"].repo_name == "r"
    assert got["https://github.com/o/widget.git/"].repo_name == "widget"
    assert got["o/r/x"].error.startswith("Invalid repository path format")
    assert got["http://x"].error.startswith("Invalid repository URL format")
    assert got["ftp://x"].error.startswith("Invalid repository path format")
    assert (got["https://dev.azure.com/org/proj/_git/repo"].project, got["https://dev.azure.com/org/proj/_git/repo"].repo_name) == ("proj", "repo")
    compat = {r.url: r.repo_name for r in R.parse_repo_url(urls, compat=True).collect()}
    assert compat["https://github.com/o/widget.git/"] == "widge"


def test_decode_modes(spark):
    raw = spark.createDataFrame([("r1", "a", 0, bytearray(b"ok"), "none"), ("r1", "b", 1, bytearray(b"x\xffy"), "none")],
                                "repo string, path string, file_seq bigint, raw binary, encoding string")
    assert [r.path for r in R.decode_contents(raw, "drop").collect()] == ["a"]
    assert {r.path: r.content for r in R.decode_contents(raw, "ignore").collect()}["b"] == "xy"
    real = spark.createDataFrame([("r1", "a", 0, bytearray("x\ufffdy".encode() + b"\xff"), "none")], raw.schema)
    assert R.decode_contents(real, "ignore").collect()[0].content == "x\ufffdy"
    assert {r.path: r.content for r in R.decode_contents(raw, "latin1").collect()}["b"] == "xÿy"


def test_reply_with_duplicate_keys_last_wins(spark):
    reply = '{"summary": "first", "summary": "second", "code_patterns": ["P"]}'
    row = X.parse_responses(_responses(spark, {"a.py": reply})).collect()[0]
    assert (row.status, row.summary) == ("parsed", "second")
    assert [i.value for i in row.code_patterns] == ["P"]


JSON_TEXTS = [
    '{"summary":"s"}', ' {"summary":"s"} \n', '{"summary":"s"} and }', '{braces}', '{"summary":"a","summary":"b"}', "{'summary':'s'}",
    '{"summary": "s", "x": }', '{"x":NaN}', '{"a":01}', '{"summary":"a\nb"}', '{"a":["x",]}', '{}', '{"summary":true // c\n}',
    '{"a":"x"}}', '{"a":"}"}', '{"a":"\\"}"}', '{"a":"\\\\"}', '{"a":1} \\"}', '{"a":1} "}"', '{"a":[{"b":[]},"]"]}', '[1]', '[1] [2]',
    '{"a":1}{"b":2}', '{"a":{"k":1,"k":2}}', '3', '3 4', '"a""b"', '', '   ', '{"a":1}\x0b', 'true', '{"a":1', '{"a":"\\x"}',
    '[[[[]]]]', '{"a":-1.5e3}', 'nul']


def _reads(text):
    try:
        json.loads(text)
    except json.JSONDecodeError:
        return False
    return True


def test_strict_json_equals_python(spark):
    from codecensus.functions.json_text import is_json
    df = spark.createDataFrame([(t,) for t in JSON_TEXTS], "t string").select("t", is_json(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {t: _reads(t) for t in JSON_TEXTS}


def test_malformed_replies_fall_back(spark):
    replies = {f"f{i}.py": t for i, t in enumerate(JSON_TEXTS)} | {
        "p1.py": "The code uses {braces} here", "p2.py": "Line one\n{not json}", "p3.py": 'pre {"summary": "s", "x": } post',
        "p4.py": "for (;;) { x = 1; }", "p5.py": 'Here: {"summary": "ok"} done'}
    for path, r in {r.path: r for r in X.parse_responses(_responses(spark, replies)).collect()}.items():
        text = replies[path]
        a, b = text.find("{"), text.rfind("}") + 1
        block = text[a:b] if 0 <= a < b else ""
        if block and _reads(block):
            assert (r.status, r.summary) == ("parsed", json.loads(block).get("summary", "No summary provided")), text
        else:
            lines = [x.strip() for x in text.split("\n") if x.strip() and not x.startswith("{")]
            assert (r.status, r.summary, r.main_functionality) == ("fallback", (lines or ["Analysis provided"])[0], text), text


def test_items_of_repeated_keys_keep_their_kinds(spark):
    reply = ('{"dependencies": "none", "dependencies": ["a, [b]", {"k": 1, "k": [2, "x"]}, 3, "}"], "key_components": [],'
             ' "code_patterns": "text", "improvement_suggestions": [{"text": "old", "text": "new, \\"q\\""}, ["z"], "s"]}')
    e = X.parse_responses(_responses(spark, {"a.py": reply}))
    items = {}
    for r in X.explanation_items(e).orderBy("pos").collect():
        items.setdefault(r.field, []).append((r.is_string, r.value))
    assert items["dependencies"][0] == (True, "a, [b]") and [k for k, _ in items["dependencies"]] == [True, False, False, True]
    assert [k for k, _ in items["improvement_suggestions"]] == [False, False, True]
    assert set(items) == {"dependencies", "improvement_suggestions"}
    issues = X.issue_candidates(X.improvement_themes(X.explanation_items(e)), X.explanation_items(e)).orderBy("o2").collect()
    assert [r.title for r in issues] == ['new, "q"', "s"]


def test_manifest_of_repeated_and_trailing_json(spark):
    from codecensus.operators import dependencies as D
    texts = {"a/package.json": '{"dependencies":{"gone":"1"},"dependencies":{"b":"1","a":"2"}}',
             "b/package.json": '{"dependencies":{"x":"1"}} }', "c/package.json": "{'dependencies':{'x':'1'}}",
             "d/composer.json": '{"require":{"p":"1"},"require-dev":[]}\n'}
    c = contents(spark, texts)
    assert {(r.path, r.package) for r in D.extract_dependencies(c).collect()} == {
        ("a/package.json", "b"), ("a/package.json", "a"), ("d/composer.json", "p")}
    assert {r.path for r in D.package_managers(c).collect()} == {"a/package.json", "d/composer.json"}
