"""§2.4 Dependency extraction: manifest text -> long rows.

Manifests are picked by exact base name anywhere in the tree, then each
parser works inside the manifest's own row (split, filter, transform over the
array of lines), so extraction is map-only. Output rows:
(repo, path, file_seq, manager, scope, pos, package) with ``pos`` the position
within the file and scope, which together with ``file_seq`` gives the
original order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import json_text as J
from codecensus.functions import sql as S
from codecensus.functions.paths import name_of
from codecensus.functions.text import WS, lines_of, strip_py

# FIXED VALUES: manifest name -> (package-manager entry, dependency key)
MANIFESTS = {
    "package.json": ("npm", "npm"),
    "requirements.txt": ("pip", "pip"),
    "Pipfile": ("pipenv", "pipenv"),
    "pyproject.toml": ("poetry", "poetry"),
    "Cargo.toml": ("cargo", None),
    "go.mod": ("go modules", "go"),
    "pom.xml": ("maven", "maven"),
    "Gemfile": ("bundler", "bundler"),
    "composer.json": ("composer", "composer"),
}
JSON_MANIFESTS = {"package.json": ("dependencies", "devDependencies"),
                  "composer.json": ("require", "require-dev")}


def manifests(contents: DataFrame) -> DataFrame:
    """Manifest files only: (repo, path, file_seq, name, content)."""
    return (contents.withColumn("name", name_of("path"))
                    .where(F.col("name").isin(list(MANIFESTS))))


def _entries(scope: str, arr: Column) -> Column:
    """array<struct<scope, pos, package>> from an array of names."""
    return F.transform(arr, lambda x, i: F.struct(F.lit(scope).alias("scope"), i.alias("pos"), x.alias("package")))


def _keys(objects: Column, field: str) -> Column:
    keys = F.map_keys(objects[field])
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<string>")))


def _stripped_lines(content: Column) -> Column:
    return F.transform(lines_of(content), strip_py)


def _json_deps(content: Column, prod: str, dev: str) -> Column:
    """Keys of the two objects in text order; of a repeated field the last
    object counts, as in Python."""
    objects = F.from_json(content, f"`{prod}` map<string,string>, `{dev}` map<string,string>", J.OPTIONS)
    return F.when(J.is_json(content), F.concat(_entries("prod", _keys(objects, prod)), _entries("dev", _keys(objects, dev))))


def _pip(content: Column) -> Column:
    items = F.filter(F.transform(lines_of(strip_py(content)), strip_py),
                     lambda l: (l != "") & ~l.startswith("#"))
    names = F.filter(F.transform(items, lambda l: strip_py(F.regexp_extract(l, "^[^><=!]*", 0))),
                     lambda p: p != "")
    return _entries("prod", names)


def _pipenv(content: Column) -> Column:
    """Section state machine without a window: stripped lines are re-joined
    and cut before every header line, so each chunk is one section."""
    joined = F.array_join(_stripped_lines(content), "\n")
    chunks = F.split(joined, r"\n(?=\[)", -1)

    def section(chunk: Column) -> Column:
        head = F.substring_index(chunk, "\n", 1)
        return (F.when(head.startswith("[packages]"), F.lit("prod"))
                 .when(head.startswith("[dev-packages]"), F.lit("dev")))

    def names(chunk: Column) -> Column:
        body = F.slice(F.split(chunk, "\n", -1), 2, 1 << 30)
        kept = F.filter(body, lambda l: l.contains("="))
        return F.transform(kept, lambda l: F.regexp_replace(strip_py(F.substring_index(l, "=", 1)), '^"+|"+$', ""))

    def scoped(scope: str) -> Column:
        picked = F.filter(chunks, lambda c: F.coalesce(section(c) == scope, F.lit(False)))
        return _entries(scope, F.flatten(F.transform(picked, names)))

    return F.concat(scoped("prod"), scoped("dev"))


def _poetry(content: Column) -> Column:
    return _entries("prod", F.regexp_extract_all(content, F.lit(r"(?U)(\w+)\s*="), 1))


def _go(content: Column) -> Column:
    req = F.filter(_stripped_lines(content), lambda l: l.startswith("require "))
    mods = F.transform(req, lambda l: F.try_element_at(F.split(l, f"{WS}+"), F.lit(2)))
    return _entries("prod", F.filter(mods, lambda m: m.isNotNull()))


def _maven(content: Column) -> Column:
    return _entries("prod", F.regexp_extract_all(content, F.lit("<artifactId>([^<]+)</artifactId>"), 1))


def _bundler(content: Column) -> Column:
    gems = F.filter(_stripped_lines(content), lambda l: l.startswith("gem "))
    names = F.transform(gems, lambda l: F.regexp_extract(l, f"gem{WS}+['\"]([^'\"]+)['\"]", 1))
    return _entries("prod", F.filter(names, lambda n: n != ""))


def _parsed(name: Column, content: Column) -> Column:
    empty = F.array().cast("array<struct<scope:string,pos:int,package:string>>")
    return (F.when(name == "package.json", _json_deps(content, *JSON_MANIFESTS["package.json"]))
             .when(name == "composer.json", _json_deps(content, *JSON_MANIFESTS["composer.json"]))
             .when(name == "requirements.txt", _pip(content))
             .when(name == "Pipfile", _pipenv(content))
             .when(name == "pyproject.toml", _poetry(content))
             .when(name == "go.mod", _go(content))
             .when(name == "pom.xml", _maven(content))
             .when(name == "Gemfile", _bundler(content))
             .otherwise(empty))


def _dep_key(name: Column) -> Column:
    e = None
    for n, (_, key) in MANIFESTS.items():
        if key is None:
            continue
        e = F.when(name == n, F.lit(key)) if e is None else e.when(name == n, F.lit(key))
    return e


def manifest_columns(name: Column, content: Column) -> list[Column]:
    """Per-file manifest outputs (NULL for other files): the dependency key,
    the parsed (scope, pos, package) rows and the package-manager entry."""
    is_manifest = name.isin(list(MANIFESTS))
    entry = None
    for n, (mgr, _) in MANIFESTS.items():
        entry = F.when(name == n, F.lit(mgr)) if entry is None else entry.when(name == n, F.lit(mgr))
    ok = ~name.isin(list(JSON_MANIFESTS)) | J.is_json(content)
    return [F.when(is_manifest, _dep_key(name)).alias("dep_manager"),
            F.when(is_manifest, _parsed(name, content)).alias("dep_items"),
            F.when(is_manifest & ok, entry).alias("pm_entry")]


def dependencies_from(features: DataFrame) -> DataFrame:
    """``extract_dependencies`` rows from per-file ``manifest_columns``."""
    rows = features.where(F.col("dep_items").isNotNull()).select(
        "repo", "path", "file_seq", F.col("dep_manager").alias("manager"), F.explode("dep_items").alias("d"))
    return rows.select("repo", "path", "file_seq", "manager", F.col("d.scope").alias("scope"),
                       F.col("d.pos").alias("pos"), F.col("d.package").alias("package"))


def package_managers_from(features: DataFrame) -> DataFrame:
    return features.where(F.col("pm_entry").isNotNull()).select(
        "repo", "path", "file_seq", F.col("pm_entry").alias("manager"))


def extract_dependencies(contents: DataFrame) -> DataFrame:
    """(repo, path, file_seq, manager, scope, pos, package) for all nine parsers."""
    m = manifests(contents)
    rows = m.select("repo", "path", "file_seq", _dep_key(F.col("name")).alias("manager"),
                    F.explode(_parsed(F.col("name"), F.col("content"))).alias("d"))
    return rows.select("repo", "path", "file_seq", "manager", F.col("d.scope").alias("scope"),
                       F.col("d.pos").alias("pos"), F.col("d.package").alias("package"))


def package_managers(contents: DataFrame) -> DataFrame:
    """(repo, path, file_seq, manager): one entry per manifest file; JSON
    manifests only when their text parses."""
    m = manifests(contents)
    entry = None
    for n, (mgr, _) in MANIFESTS.items():
        entry = F.when(F.col("name") == n, F.lit(mgr)) if entry is None else entry.when(F.col("name") == n, F.lit(mgr))
    ok = ~F.col("name").isin(list(JSON_MANIFESTS)) | J.is_json(F.col("content"))
    return m.where(ok).select("repo", "path", "file_seq", entry.alias("manager"))


def package_managers_basic(contents: DataFrame) -> DataFrame:
    """(repo, pos, manager): pip, npm, maven when any path ends with the
    manifest name (case-insensitive), once each, in that order."""
    lp = F.lower(F.col("path"))
    flags = contents.groupBy("repo").agg(
        *[F.bool_or(lp.endswith(suffix)).alias(mgr) for mgr, suffix in rules.BASIC_MANAGERS])
    arr = F.array_compact(F.array(*[F.when(F.col(mgr), F.lit(mgr)) for mgr, _ in rules.BASIC_MANAGERS]))
    return (flags.select("repo", F.posexplode(arr).alias("pos", "manager"))
                 .select("repo", F.col("pos").cast("int"), "manager"))


def dependency_totals(deps: DataFrame) -> DataFrame:
    """Rows per (repo, scope, manager) with rollup subtotals per scope and
    per repo (duplicates counted)."""
    return (deps.rollup("repo", "scope", "manager").agg(F.count(F.lit(1)).alias("dependencies"))
                .where(F.col("repo").isNotNull()))


def top_dependencies(deps: DataFrame, prod_n: int = rules.PROD_DEPS_SHOWN,
                     dev_n: int = rules.DEV_DEPS_SHOWN) -> DataFrame:
    """First ``prod_n`` production and ``dev_n`` development packages per
    (repo, manager) in file order, with the total and the 'N more' count."""
    w = Window.partitionBy("repo", "scope", "manager").orderBy("file_seq", "pos")
    cap = F.when(F.col("scope") == "prod", F.lit(prod_n)).otherwise(F.lit(dev_n))
    top = (deps.withColumn("rank", F.row_number().over(w))
               .where(F.col("rank") <= F.greatest(F.lit(prod_n), F.lit(dev_n)))
               .where(F.col("rank") <= cap))
    totals = deps.groupBy("repo", "scope", "manager").agg(F.count(F.lit(1)).alias("total"))
    return (top.join(totals, ["repo", "scope", "manager"])
               .select("repo", "scope", "manager", "rank", "package", "total",
                       F.greatest(F.col("total") - cap, F.lit(0)).alias("more")))


def _tool_hits(pkg_lower: str = "lower(package)") -> Column:
    hits = []
    for group, table in rules.TOOLING_GROUPS:
        for t_i, (tool, pats) in enumerate(table.items()):
            cond = S.contains_any(pkg_lower, [p.lower() for p in pats])
            hits.append(f"CASE WHEN {cond} THEN named_struct('grp', {S.q(group)}, 'tool', {S.q(tool)}, "
                        f"'tool_idx', {t_i}) END")
    return S.expr("array_compact(array(" + ", ".join(hits) + "))")


def identify_tooling(deps: DataFrame) -> DataFrame:
    """(repo, category, rank, tool): frameworks, testing frameworks and build
    tools named by npm packages (substring match), in order of first hit."""
    npm = deps.where(F.col("manager") == "npm")
    scope_rank = F.when(F.col("scope") == "prod", F.lit(0)).otherwise(F.lit(1))
    hits = npm.select("repo", "file_seq", scope_rank.alias("scope_rank"), "pos",
                      F.explode(_tool_hits()).alias("h"))
    first = hits.groupBy("repo", F.col("h.grp").alias("category"), F.col("h.tool").alias("tool")).agg(
        F.min(F.struct("file_seq", "scope_rank", "pos", F.col("h.tool_idx").alias("tool_idx"))).alias("first"))
    w = Window.partitionBy("repo", "category").orderBy("first")
    return first.select("repo", "category", F.row_number().over(w).alias("rank"), "tool")


def _single(contents: DataFrame, manifest: str) -> DataFrame:
    """One parser: the manifest's rows of ``extract_dependencies``."""
    only = contents.where(S.expr(f"{S.name('path')} = {S.q(manifest)}"))
    return extract_dependencies(only)


def deps_npm(contents: DataFrame) -> DataFrame:
    """package.json: keys of dependencies (prod) and devDependencies (dev)."""
    return _single(contents, "package.json")


def deps_pip(contents: DataFrame) -> DataFrame:
    """requirements.txt: text before the first of > < = ! on kept lines."""
    return _single(contents, "requirements.txt")


def deps_pipenv(contents: DataFrame) -> DataFrame:
    """Pipfile: names under [packages] (prod) and [dev-packages] (dev)."""
    return _single(contents, "Pipfile")


def deps_poetry(contents: DataFrame) -> DataFrame:
    """pyproject.toml: every word followed by '='."""
    return _single(contents, "pyproject.toml")


def deps_cargo(contents: DataFrame) -> DataFrame:
    """Cargo.toml: the package-manager entry only (no packages are read)."""
    return package_managers(contents.where(S.expr(f"{S.name('path')} = 'Cargo.toml'")))


def deps_go(contents: DataFrame) -> DataFrame:
    """go.mod: second token of 'require ' lines."""
    return _single(contents, "go.mod")


def deps_maven(contents: DataFrame) -> DataFrame:
    """pom.xml: every artifactId value."""
    return _single(contents, "pom.xml")


def deps_bundler(contents: DataFrame) -> DataFrame:
    """Gemfile: quoted name on 'gem ' lines."""
    return _single(contents, "Gemfile")


def deps_composer(contents: DataFrame) -> DataFrame:
    """composer.json: keys of require (prod) and require-dev (dev)."""
    return _single(contents, "composer.json")
