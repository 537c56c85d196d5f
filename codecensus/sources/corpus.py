"""Layer-B corpus: repository tables derived from the driver's tables.

The driver tables hold prose, not code. Paths and short code-like preambles are
synthesised from ``doc_id`` while ``content`` keeps the real document text, so
the work of every operator grows with ``documents`` (and ``orders`` for the
activity tables). All derivations are narrow projections except ``repos`` and
``ado_listing_pages``, which aggregate to bounded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecensus.functions.paths import directory_of, name_of, suffix_of
from codecensus.rules import LANGUAGE_EXTENSIONS

NL = "\n"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


# FIXED VALUES (layer-B fixture): file kinds 0..19 and manifest names by r % 9
KIND_PATHS = ["src/main.py", "src/utils.js", "tests/test_core.py", "README.md",
              "models/user.java", "services/api.go", "components/widget.tsx",
              "config/settings.yaml", "node_modules/lib/index.js", "build/out.class",
              ".hidden", ".gitignore", "Dockerfile", "core/engine.rs", "domain/handler.kt",
              None, "assets/logo.png", "Makefile", None, "webpack.config.js"]
MANIFEST_NAMES = ["package.json", "composer.json", "go.mod", "pom.xml", "Gemfile", "Pipfile",
                  "pyproject.toml", "Cargo.toml", "build.gradle"]
PREAMBLES = ["# note", "// note", "    import kafka", "class A uses postgres and boto3",
             "                def f(): graphql"]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _base_path(kind: Column, r: Column) -> Column:
    """Compact on purpose: Catalyst may inline this expression into every
    pushed-down predicate on ``path``, so it is a few array lookups rather
    than a 20-branch CASE."""
    fixed = F.element_at(_lit_array(KIND_PATHS), (kind + 1).cast("int"))
    manifest = F.element_at(_lit_array(MANIFEST_NAMES), (r % 9 + 1).cast("int"))
    k18 = F.element_at(_lit_array(["docker-compose.yml", "requirements.txt"]), (r % 2 + 1).cast("int"))
    return F.coalesce(fixed, F.when(kind == 15, manifest).otherwise(k18))


def _json_manifest(prod: str, package: str, dev: str, dev_packages: str, seq: Column) -> Column:
    """A JSON manifest: well-formed, with a repeated key, with text behind
    it, in single quotes, cut off, or with a brace in a key."""
    name = F.concat(F.lit(package), _s(seq % 7))
    text = F.concat(F.lit('{"' + prod + '":{"'), name, F.lit('":"1"},"' + dev + '":{' + dev_packages + "}}"))
    behind = F.substring(text, F.lit(2), F.length(text))
    return F.element_at(F.array(
        text,
        F.concat(F.lit('{"' + prod + '":{"gone":"0"},'), behind),
        F.concat(text, F.lit(" and more }")),
        F.replace(text, F.lit('"'), F.lit("'")),
        F.substring(text, F.lit(1), F.length(text) - 1),
        F.concat(F.lit('{"a}b":[{"c":"]"}],'), behind, F.lit(NL)),
    ), (F.floor(seq / 200) % 6 + 1).cast("int"))


def _manifest_text(kind: Column, r: Column, seq: Column) -> Column:
    """Text of the synthesised manifest files (NULL for prose files)."""
    s7 = _s(seq % 7)
    manifest_text = F.element_at(F.array(
        _json_manifest("dependencies", 'react":"18","lib', "devDependencies", '"jest":"29","webpack":"5"', seq),
        _json_manifest("require", 'laravel/framework":"10","p', "require-dev", '"phpunit":"1"', seq),
        F.lit("module x" + NL + "require m.example/a v1" + NL + "require (" + NL + "  m.example/b v2" + NL + ")"),
        F.concat(F.lit("<project><artifactId>app</artifactId><dependency><artifactId>lib"), s7,
                 F.lit("</artifactId></dependency></project>")),
        F.concat(F.lit("gem 'rails'" + NL + 'gem "g'), s7, F.lit('"' + NL + "# gem 'no'")),
        F.lit("[packages]" + NL + 'requests = "*"' + NL + "[dev-packages]" + NL + 'pytest = "*"'
              + NL + "[requires]" + NL + 'python_version = "3"'),
        F.concat(F.lit("[tool.poetry.dependencies]" + NL + 'flask = "2"' + NL + "q"), s7, F.lit(' = "1"')),
    ), (r % 9 + 1).cast("int"))
    pins = F.concat(F.lit("# pins" + NL + "django==4.2" + NL + "pkg"), _s(seq % 5),
                    F.lit(">=1.0" + NL + "tilde~=1.0" + NL))
    return (F.when((kind == 15) & (r % 9 < 7), manifest_text)
             .when((kind == 18) & (r % 2 == 1), pins))


def _preamble(seq: Column) -> Column:
    return F.element_at(_lit_array(PREAMBLES), (seq % 5 + 1).cast("int"))


def _content(kind: Column, r: Column, seq: Column, text: Column) -> Column:
    return F.coalesce(_manifest_text(kind, r, seq), F.concat(_preamble(seq), F.lit(NL + NL), text))


def _size(kind: Column, r: Column, seq: Column, n_chars: Column) -> Column:
    """length(content) without reading the text: the prose text's length is
    ``documents.n_chars``."""
    return F.coalesce(F.length(_manifest_text(kind, r, seq)),
                      F.length(_preamble(seq)) + 2 + n_chars).cast("bigint")


def _keys(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    cols = ["doc_id", "source", "n_chars"] + (["text"] if with_text else [])
    d = _table(spark, sf_dir, "documents").select(*cols)
    k = F.floor(F.col("doc_id") / 20).cast("bigint")
    return d.select(F.col("source").alias("repo"), F.col("doc_id").alias("file_seq"), "n_chars",
                    *(["text"] if with_text else []),
                    (F.col("doc_id") % 20).alias("r"), k.alias("k"),
                    ((k + F.col("doc_id")) % 20).alias("kind"))


def _path(kind: Column, r: Column, k: Column, seq: Column) -> Column:
    base = _base_path(kind, r)
    return F.when(k < 20, base).otherwise(F.concat(F.lit("m"), _s(seq), F.lit("/"), base))


def listing_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_seq, kind, r, path, size) without reading any text."""
    a = _keys(spark, sf_dir, with_text=False)
    kind, r, seq = F.col("kind"), F.col("r"), F.col("file_seq")
    return a.select("repo", "file_seq", "kind", "r", _path(kind, r, F.col("k"), seq).alias("path"),
                    _size(kind, r, seq, F.col("n_chars")).alias("size"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_seq, kind, r, path, content, size) — one row per document."""
    a = _keys(spark, sf_dir, with_text=True)
    # the test tables are files of one row group, which no split size divides
    a = a.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind, r, seq = F.col("kind"), F.col("r"), F.col("file_seq")
    return a.select("repo", "file_seq", "kind", "r", _path(kind, r, F.col("k"), seq).alias("path"),
                    _content(kind, r, seq, F.col("text")).alias("content"),
                    _size(kind, r, seq, F.col("n_chars")).alias("size"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing: (repo, file_seq, path, name, type, size). Reads no text."""
    c = listing_meta(spark, sf_dir)
    return c.select("repo", "file_seq", "path", name_of("path").alias("name"),
                    F.lit("file").alias("type"), "size")


def listing_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing columns plus ``content`` in one row (one scan, no join): the
    corpus stores both, so listing filters apply to the text directly."""
    c = corpus(spark, sf_dir)
    return c.select("repo", "file_seq", "path", name_of("path").alias("name"),
                    F.lit("file").alias("type"), "size", "content")


def snapshot(spark: SparkSession, sf_dir: str, early: bool = False) -> DataFrame:
    """The listing with text and ``sha``, as it is now or as it was."""
    now = listing_with_text(spark, sf_dir).withColumn("sha", F.sha1("content"))
    return earlier(now) if early else now


def earlier(now: DataFrame) -> DataFrame:
    """A snapshot as it was: one repository in five lacked files, had others
    that are gone, and files with another text."""
    seq, moving = F.col("file_seq"), F.crc32("repo") % 5 == 0
    shorter = F.concat(F.lit("earlier" + NL), F.substring(F.col("content"), F.lit(1), (F.length("content") / 2).cast("int")))
    gone = now.where(moving & (seq % 11 == 5)).withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    c = (now.where(~(moving & (seq % 9 == 4)))
         .withColumn("content", F.when(moving & (seq % 7 == 2), shorter).otherwise(F.col("content"))).unionByName(gone))
    return c.withColumn("size", F.length("content").cast("bigint")).withColumn("sha", F.sha1("content"))


def early_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository records as they were: some had fewer stars."""
    fewer = F.when(F.crc32("repo") % 7 == 0, F.col("stars") - 1).otherwise(F.col("stars"))
    return repos(spark, sf_dir).withColumn("stars", fewer)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, file_seq, content)."""
    return corpus(spark, sf_dir).select("repo", "path", "file_seq", "content")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies for the code files of the corpus, which quote the given
    texts; 1 in 11 is not strict JSON (no braces, braces in prose, cut
    objects, single quotes, text after the object) and 1 in 17 calls failed
    (``error`` set). Some repeat keys, have objects among their suggestions
    and a '|' in a pattern."""
    a = _keys(spark, sf_dir, with_text=True)
    seq = F.col("file_seq")
    c = a.select("repo", "file_seq", _path(F.col("kind"), F.col("r"), F.col("k"), seq).alias("path"), "text")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]+", "")
    does = F.when(seq % 2 == 0, F.concat(F.lit('"main_functionality":"'), letters, F.lit('",'))).otherwise(F.lit(""))
    more = (F.when(seq % 10 == 5, F.concat(F.lit(',{"description":"Cache '), _s(seq % 7), F.lit('"}')))
            .when(seq % 15 == 0, F.concat(F.lit(',{"text":"Old","text":"Split test '), _s(seq % 7), F.lit('"}')))
            .when(seq % 5 == 0, F.concat(F.lit(',{"text":"Split part '), _s(seq % 7), F.lit('"}'))).otherwise(F.lit("")))
    twice = F.when(seq % 13 == 3, F.lit('"summary":"Old","code_patterns":"none","dependencies":[{"x":1},"gone"],')).otherwise(F.lit(""))
    both = F.when(seq % 6 == 0, F.lit(',"A|B"')).otherwise(F.lit(""))
    cx = (F.when(seq % 3 == 0, "Simple. ok").when(seq % 3 == 1, "Moderate - x").otherwise("Complex"))
    sug = (F.when(seq % 4 == 0, "Add unit tests").when(seq % 4 == 1, "Improve error handling")
           .when(seq % 4 == 2, "Optimize performance").otherwise("Refactor names"))
    path = F.col("path")
    broken = F.element_at(F.array(
        F.concat(F.lit("No JSON here" + NL), path),
        F.concat(F.lit("The code uses {braces} in "), path),
        F.concat(F.lit("{ " + NL + "First line of "), path, F.lit(NL + "{not json}")),
        F.concat(F.lit('Cut {"summary": "s", "x": } for '), path),
        F.concat(F.lit("{'summary': 'single quotes in "), path, F.lit("'}")),
        F.concat(F.lit('{"summary":"'), path, F.lit('"} and }')),
        F.concat(F.lit('{"summary":"one"} {"summary":"'), path, F.lit('"}')),
        F.concat(F.lit("for (;;) { x = 1; }" + NL), path)), (F.floor(seq / 11) % 8 + 1).cast("int"))
    reply = F.when(seq % 11 == 0, broken).otherwise(F.concat(
        F.lit('Here: {'), twice, F.lit('"summary":"S'), _s(seq), F.lit(" "), F.md5(F.coalesce("text", F.lit(""))), F.lit('",'), does,
        F.lit('"complexity_assessment":"'), cx, F.lit('","key_components":["part '), _s(seq % 5),
        F.lit('","core"],"dependencies":["dep'), _s(seq % 9), F.lit('","json"],"code_patterns":["P'),
        _s(seq % 4), F.lit('"'), both, F.lit('],"improvement_suggestions":["'), sug, F.lit('"'), more,
        F.lit(']} done')))
    code = (F.col("path").like("%.py") | F.col("path").like("%.js") | F.col("path").like("%.go")
            | F.col("path").like("%.rs") | F.col("path").like("%.java"))
    err = F.when(seq % 17 == 0, F.lit("LLM API error: timeout"))
    return c.where(code).select("repo", "path", "file_seq", reply.alias("response"), err.alias("error"))


def focus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_meta(spark, sf_dir).where(F.col("kind") == 5).select("repo", "path")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, message, author, date, url, branch) from ``orders``."""
    o = _orders(spark, sf_dir)
    repo = F.concat(F.lit("src"), _s(F.col("o_custkey") % 20))
    sha = F.md5(_s(F.col("o_orderkey")))
    return o.select(repo.alias("repo"), sha.alias("sha"),
                    F.concat(F.col("o_orderpriority"), F.lit(NL + "body")).alias("message"),
                    _s(F.col("o_custkey")).alias("author"),
                    F.col("o_orderdate").alias("date"),
                    F.concat(F.lit("https://github.com/org/"), repo, F.lit("/commit/"), sha).alias("url"),
                    F.col("o_orderpriority").alias("branch"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, pr_id, title, status): O -> active, F -> completed, P -> abandoned."""
    o = _orders(spark, sf_dir)
    st = (F.when(F.col("o_orderstatus") == "O", "active")
          .when(F.col("o_orderstatus") == "F", "completed").otherwise("abandoned"))
    return o.select(F.concat(F.lit("src"), _s(F.col("o_custkey") % 20)).alias("repo"),
                    F.col("o_orderkey").alias("pr_id"),
                    F.concat(F.lit("Order "), _s(F.col("o_orderkey"))).alias("title"),
                    st.alias("status"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir).select("repo", "branch").distinct()


def project_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("project"), F.col("source").alias("repo")).distinct()


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("lang").alias("project")).distinct()


def open_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    t = F.explode(F.array(F.lit("Add unit tests"), F.lit("investigate: testing")))
    return r.select("repo", t.alias("title"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository records, one per ``source``; languages = bytes per language.

    Two bounded aggregations: per (repo, language) then per repo (at most 42
    map entries per repository).
    """
    c = listing_meta(spark, sf_dir).select("repo", "file_seq", "r", "path", "size")
    lang_map = F.create_map(*[x for kv in LANGUAGE_EXTENSIONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    per_lang = (c.withColumn("language", F.element_at(lang_map, suffix_of("path")))
                 .where(F.col("language").isNotNull())
                 .groupBy("repo", "language").agg(F.sum("size").alias("bytes")))
    langs = per_lang.groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "bytes")))).alias("languages"),
        F.max_by("language", F.struct("bytes", F.col("language"))).alias("language"))
    base = c.groupBy("repo").agg(
        F.min("r").alias("r"), F.sum("file_seq").alias("seq_sum"),
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    r = F.col("r")
    day = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    return (base.join(langs, "repo", "left").select(
        "repo",
        F.concat(F.lit("org/"), F.col("repo")).alias("full_name"),
        F.concat(F.lit("Corpus repository "), F.col("repo")).alias("description"),
        F.concat(F.lit("https://github.com/org/"), F.col("repo")).alias("url"),
        F.concat(F.lit("https://github.com/org/"), F.col("repo"), F.lit(".git")).alias("clone_url"),
        "language", "languages",
        (F.col("seq_sum") % 5000).cast("int").alias("stars"),
        (F.col("n") % 300).cast("int").alias("forks"),
        (F.col("seq_sum") % 777).cast("int").alias("watchers"),
        F.floor(F.col("bytes") / 1024).cast("bigint").alias("size"),
        F.lit("main").alias("default_branch"),
        (day + F.make_interval(days=r.cast("int"))).alias("created_at"),
        (day + F.make_interval(days=(r * 30).cast("int"))).alias("updated_at"),
        (day + F.make_interval(days=(r * 31).cast("int"))).alias("pushed_at"),
        F.array(F.lit("analytics"), F.concat(F.lit("group"), _s(r % 3))).alias("topics"),
        F.when(r % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("MIT License")).alias("license"),
        (r % 2 == 0).alias("has_issues"), (r % 3 == 0).alias("has_projects"),
        (r % 5 != 0).alias("has_wiki"), F.lit(False).alias("archived"),
        F.lit(False).alias("disabled"), F.lit(False).alias("private")))


def ado_listing_pages(spark: SparkSession, sf_dir: str, page_size: int = 50) -> DataFrame:
    """Raw listing replies ``{"value":[...]}``, one row per (repo, page).

    Items are the corpus files (leading '/', ``isFolder`` false) and one folder
    item per directory, placed before the first file in it. Folders named
    ``assets`` omit ``isFolder``. Each page holds at most ``2 * page_size``
    items, so no group grows with the data.
    """
    c = listing_meta(spark, sf_dir).select("repo", "file_seq", "path", "size")
    file_items = c.select(
        "repo", "file_seq", F.lit(1).alias("ord"),
        F.to_json(F.struct(F.concat(F.lit("/"), F.col("path")).alias("path"),
                           F.lit(False).alias("isFolder"), F.col("size").alias("size"))).alias("item"))
    dirs = (c.where(F.col("path").contains("/"))
             .groupBy("repo", directory_of("path").alias("dir")).agg(F.min("file_seq").alias("file_seq")))
    folder_json = F.when(
        F.element_at(F.split("dir", "/"), -1) == "assets",
        F.to_json(F.struct(F.concat(F.lit("/"), F.col("dir")).alias("path"))),
    ).otherwise(F.to_json(F.struct(F.concat(F.lit("/"), F.col("dir")).alias("path"),
                                   F.lit(True).alias("isFolder"))))
    folder_items = dirs.select("repo", "file_seq", F.lit(0).alias("ord"), folder_json.alias("item"))
    items = file_items.unionByName(folder_items).withColumn(
        "page", F.floor(F.col("file_seq") / page_size).cast("bigint"))
    pages = items.groupBy("repo", "page").agg(
        F.array_sort(F.collect_list(F.struct("file_seq", "ord", "item"))).alias("items"))
    return pages.select(
        "repo", "page",
        F.concat(F.lit('{"value":['), F.array_join(F.transform("items", lambda x: x["item"]), ","),
                 F.lit("]}")).alias("json"))


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as ``.html`` files: (repo, path, file_seq, content)."""
    p = _table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    rest = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    path = F.concat(F.when(rest == "", F.lit("index")).otherwise(rest), F.lit(".html"))
    return p.select(host.alias("repo"), path.alias("path"), F.col("page_id").alias("file_seq"),
                    F.col("html").alias("content"))


def raw_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecoded text: (repo, path, file_seq, raw, encoding). Every file is
    base64 of its UTF-8 bytes; every 13th also gets a U+FFFD and a U+10FFFE
    character and a stray 0xFF byte, so its bytes are not valid UTF-8. Odd
    files are given as raw bytes."""
    c = contents(spark, sf_dir)
    data = F.when(F.col("file_seq") % 13 == 0, F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("EFBFBDF48FBFBEFF")))) \
            .otherwise(F.encode("content", "UTF-8"))
    b64 = F.col("file_seq") % 2 == 0
    return c.select("repo", "path", "file_seq",
                    F.when(b64, F.base64(data).cast("binary")).otherwise(data).alias("raw"),
                    F.when(b64, F.lit("base64")).otherwise(F.lit("none")).alias("encoding"))


def url_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository references in every accepted and rejected form: GitHub
    URLs (with '.git' and trailing '/'), 'owner/repo', both Azure DevOps
    forms, deep 'a/b/c' paths and the web-page URLs of ``pages``."""
    pr = project_repos(spark, sf_dir)
    gh = pr.select(F.concat(F.lit("https://github.com/"), F.col("project"), F.lit("/"), F.col("repo")).alias("url"))
    gh_git = pr.select(F.concat(F.lit("https://github.com/"), F.col("project"), F.lit("/widget"),
                                F.col("repo"), F.lit(".git/")).alias("url"))
    short = pr.select(F.concat(F.col("project"), F.lit("/"), F.col("repo")).alias("url"))
    deep = pr.select(F.concat(F.col("project"), F.lit("/"), F.col("repo"), F.lit("/x")).alias("url"))
    ado = pr.select(F.concat(F.lit("https://dev.azure.com/org/"), F.col("project"), F.lit("/_git/"),
                             F.col("repo")).alias("url"))
    ado_old = pr.select(F.concat(F.lit("https://org"), F.col("project"), F.lit(".visualstudio.com/"),
                                 F.col("project"), F.lit("/_git/"), F.col("repo"), F.lit("/")).alias("url"))
    web = _table(spark, sf_dir, "pages").select("url")
    return gh.unionByName(gh_git).unionByName(short).unionByName(deep).unionByName(ado) \
             .unionByName(ado_old).unionByName(web)
