"""§2.4-§2.6: line metrics (A5), project type and architecture (A6, A7),
manifests (A3, A4) and tooling (A8)."""
from pyspark.sql import functions as F

from codecensus.operators import dependencies as D
from codecensus.operators import metrics as M
from codecensus.operators import patterns as PT
from corpus_helpers import contents, listing

PY = '''
# This is a comment
import os

def hello_world():
    # Another comment
    print("Hello, World!")
    
    if True:
        print("Indented")

# Final comment
'''.strip()


def test_file_metrics_a5(spark):
    fm = M.file_metrics(contents(spark, {"x.py": PY})).collect()[0]
    assert fm.code_lines > 0 and fm.comment_lines > 0 and fm.max_indentation > 0
    assert fm.lines == fm.blank_lines + fm.comment_lines + fm.code_lines
    assert (fm.lines, fm.comment_lines, fm.blank_lines) == (11, 3, 3)


def test_line_classes_add_up(spark):
    texts = {f"f{i}.js": "\n".join(("  // c" if j % 3 == 0 else ("" if j % 4 == 0 else "x = 1"))
                                   for j in range(i)) for i in range(1, 40)}
    for r in M.file_metrics(contents(spark, texts)).collect():
        assert r.lines == r.blank_lines + r.comment_lines + r.code_lines


def test_splitlines_matches_python(spark):
    samples = ["a\nb\n", "", "a\r\nb", "a\rb\n\n", "x\x0by"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(M.splitlines(F.col("t"))).collect()]
    assert got == [s.splitlines() for s in samples]


def _flags(spark, files: dict):
    lt = listing(spark, [(p, 1) for p in files], with_content=files)
    return PT.pattern_flags(lt)


def test_project_type_a6(spark):
    f = _flags(spark, {"package.json": '{"dependencies": {"react": "^18.0.0"}}', "src/index.js": None})
    assert PT.detect_project_type(f).collect()[0].project_type == "Frontend Web Application"
    f = _flags(spark, {"requirements.txt": "django==4.2.0", "main.py": None})
    assert PT.detect_project_type(f).collect()[0].project_type == "Django Web Application"


def test_architecture_a7(spark):
    f = _flags(spark, {"models/user.py": "", "views/home.py": "", "controllers/c.py": ""})
    assert "MVC (Model-View-Controller)" in [r.pattern for r in PT.detect_architecture(f).collect()]
    f = _flags(spark, {"docker-compose.yml": "", "services/a.py": ""})
    assert "Microservices" in [r.pattern for r in PT.detect_architecture(f).collect()]


def test_api_type_order(spark):
    f = _flags(spark, {"a.py": "uses GraphQL and a REST router"})
    assert PT.detect_api_type(f).collect()[0].api_type == "GraphQL"
    f = _flags(spark, {"a.py": "plain text"})
    assert PT.detect_api_type(f).collect()[0].api_type is None


def _deps(spark, files):
    return D.extract_dependencies(contents(spark, files))


def test_package_json_a3(spark):
    d = _deps(spark, {"package.json": '{"dependencies": {"react": "^18", "express": "^4"}, '
                                      '"devDependencies": {"jest": "^29", "webpack": "^5"}}'})
    rows = [(r.scope, r.package) for r in d.orderBy("scope", "pos").collect()]
    assert rows == [("dev", "jest"), ("dev", "webpack"), ("prod", "react"), ("prod", "express")]


def test_requirements_a4(spark):
    d = _deps(spark, {"requirements.txt": "django==4.2.0\nrequests>=2.28.0\n# comment\npytest==7.4.0\nnumpy==1.24.0"})
    assert [r.package for r in d.orderBy("pos").collect()] == ["django", "requests", "pytest", "numpy"]


def test_other_manifests(spark):
    d = _deps(spark, {
        "Pipfile": '[packages]\nrequests = "*"\n[dev-packages]\npytest = "*"\n[requires]\npython_version = "3"',
        "go.mod": "module x\nrequire m.example/a v1\nrequire (\n  m.example/b v2\n)",
        "pom.xml": "<artifactId>app</artifactId><artifactId>lib</artifactId>",
        "Gemfile": "gem 'rails'\ngem \"pg\"\n# gem 'no'",
        "composer.json": '{"require": {"laravel/framework": "10"}, "require-dev": {"phpunit": "1"}}',
        "pyproject.toml": '[tool.poetry.dependencies]\nflask = "2"',
        "Cargo.toml": "[dependencies]\nserde = 1",
    })
    got = {}
    for r in d.orderBy("file_seq", "scope", "pos").collect():
        got.setdefault((r.manager, r.scope), []).append(r.package)
    assert got[("pipenv", "prod")] == ["requests"] and got[("pipenv", "dev")] == ["pytest"]
    assert got[("go", "prod")] == ["m.example/a", "("]
    assert got[("maven", "prod")] == ["app", "lib"]
    assert got[("bundler", "prod")] == ["rails", "pg"]
    assert got[("composer", "prod")] == ["laravel/framework"] and got[("composer", "dev")] == ["phpunit"]
    assert got[("poetry", "prod")] == ["flask"]
    managers = [r.manager for r in D.package_managers(contents(spark, {"Cargo.toml": "", "package.json": "{bad"}))
                .collect()]
    assert managers == ["cargo"]


def test_tooling_a8(spark):
    d = _deps(spark, {"package.json": '{"dependencies": {"react": "1", "express": "1", "django": "1"}, '
                                      '"devDependencies": {"jest": "1", "pytest": "1", "webpack": "1"}}'})
    tools = {}
    for r in D.identify_tooling(d).orderBy("category", "rank").collect():
        tools.setdefault(r.category, []).append(r.tool)
    assert tools["frameworks"] == ["React", "Express.js", "Django"]
    assert tools["testing_frameworks"] == ["Jest", "pytest"]
    assert tools["build_tools"] == ["Webpack"]
