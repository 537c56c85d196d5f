"""SQL fragments for the DuckDB oracle, generated from the same fixed rule
tables the Spark operators use (rules.py), so both sides state one rule set.
"""

from __future__ import annotations

import re

from codecensus import rules
from codecensus.functions.text import WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def contains_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def ends_with_any(expr: str, endings) -> str:
    return "(" + " or ".join(f"ends_with({expr}, {q(e)})" for e in endings) + ")"


def name(p: str = "path") -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def suffix(p: str = "path") -> str:
    return f"lower(regexp_extract({name(p)}, '^.+(\\.[^.]+)$', 1))"


def directory(p: str = "path") -> str:
    return f"(case when contains({p}, '/') then regexp_extract({p}, '^(.*)/[^/]*$', 1) else 'root' end)"


def parent(p: str = "path") -> str:
    return f"(case when contains({p}, '/') then regexp_extract({p}, '([^/]*)/[^/]*$', 1) else '' end)"


def case_map(expr: str, d: dict, default: str = "null") -> str:
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in d.items())
    return f"(case {expr} {whens} else {default} end)"


WS_SQL = WS  # same character class text works in RE2


def category_flags(p: str = "path") -> dict[str, str]:
    n = name(p)
    ln = f"lower({n})"
    lp = f"lower({p})"
    return {
        "source": f"({ends_with_any(n, rules.LANGUAGE_EXTENSIONS.keys())} and not contains({lp}, 'test') "
                  f"and not contains({ln}, 'config') and not starts_with({n}, '.'))",
        "test": f"({contains_any(lp, rules.TEST_PATH_WORDS)} or {contains_any(ln, rules.TEST_NAME_WORDS)})",
        "config": f"({n} in {in_list(rules.CONFIG_FILES.keys())} or {contains_any(ln, rules.CONFIG_NAME_WORDS)})",
        "documentation": f"({contains_any(ln, rules.DOC_NAME_WORDS)} or {ends_with_any(n, rules.DOC_ENDINGS)})",
        "build": f"({contains_any(ln, rules.BUILD_NAME_WORDS)} or {ends_with_any(n, rules.BUILD_ENDINGS)})",
    }


def basic_category_flags(p: str = "path") -> dict[str, str]:
    lp = f"lower({p})"
    return {
        "source": f"({case_map(suffix(p), rules.CODE_EXTENSIONS)} is not null)",
        "test": f"(contains({lp}, 'test') or starts_with({lp}, 'tests') or contains({lp}, '/tests/'))",
        "config": contains_any(lp, rules.BASIC_CONFIG_MARKERS),
        "documentation": contains_any(lp, rules.BASIC_DOC_MARKERS),
        "build": contains_any(p, rules.BASIC_BUILD_MARKERS),
    }


def priority(p: str = "path") -> str:
    n = f"lower({name(p)})"
    s = suffix(p)
    w = rules.PRIORITY_WEIGHTS
    return ("(" + " + ".join([
        f"(case when {n} in {in_list(rules.PRIORITY_KEY_NAMES)} then {w['key']} else 0 end)",
        f"(case when {contains_any(n, rules.PRIORITY_CONFIG_WORDS)} then {w['config']} else 0 end)",
        f"(case when {s} in {in_list(rules.PRIORITY_SOURCE_EXTS)} then {w['source']} else 0 end)",
        f"(case when {contains_any(n, rules.PRIORITY_TEST_WORDS)} then {w['test']} else 0 end)",
        f"(case when {s} in {in_list(rules.PRIORITY_DOC_EXTS)} then {w['doc']} else 0 end)",
        f"(case when not contains({p}, '/') then {w['root']} else 0 end)",
    ]) + ")")


def filter_keep(p: str = "path") -> str:
    n = name(p)
    return (f"(type = 'file' and not list_has_any(string_split({p}, '/'), {sql_list(rules.EXCLUDED_DIRS)}) "
            f"and {suffix(p)} not in {in_list(rules.EXCLUDED_EXTENSIONS)} "
            f"and not (starts_with({n}, '.') and {n} not in {in_list(rules.HIDDEN_ALLOWED)}))")


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


CORPUS = r"""
corpus as (
select repo, file_seq, kind, r, text,
  case when k < 20 then base else 'm' || cast(file_seq as varchar(20)) || '/' || base end as path,
  content, cast(length(content) as bigint) as size
from (
 select repo, file_seq, k, r, kind, text,
  case kind when 0 then 'src/main.py' when 1 then 'src/utils.js' when 2 then 'tests/test_core.py'
   when 3 then 'README.md' when 4 then 'models/user.java' when 5 then 'services/api.go'
   when 6 then 'components/widget.tsx' when 7 then 'config/settings.yaml' when 8 then 'node_modules/lib/index.js'
   when 9 then 'build/out.class' when 10 then '.hidden' when 11 then '.gitignore' when 12 then 'Dockerfile'
   when 13 then 'core/engine.rs' when 14 then 'domain/handler.kt'
   when 15 then case r % 9 when 0 then 'package.json' when 1 then 'composer.json' when 2 then 'go.mod'
     when 3 then 'pom.xml' when 4 then 'Gemfile' when 5 then 'Pipfile' when 6 then 'pyproject.toml'
     when 7 then 'Cargo.toml' else 'build.gradle' end
   when 16 then 'assets/logo.png' when 17 then 'Makefile'
   when 18 then case when r % 2 = 1 then 'requirements.txt' else 'docker-compose.yml' end
   else 'webpack.config.js' end as base,
  case
   when kind = 15 and r % 9 = 0 then json_npm
   when kind = 15 and r % 9 = 1 then json_composer
   when kind = 15 and r % 9 = 2 then 'module x' || chr(10) || 'require m.example/a v1' || chr(10) || 'require (' || chr(10) || '  m.example/b v2' || chr(10) || ')'
   when kind = 15 and r % 9 = 3 then '<project><artifactId>app</artifactId><dependency><artifactId>lib' || cast(file_seq % 7 as varchar(10)) || '</artifactId></dependency></project>'
   when kind = 15 and r % 9 = 4 then 'gem ''rails''' || chr(10) || 'gem "g' || cast(file_seq % 7 as varchar(10)) || '"' || chr(10) || '# gem ''no'''
   when kind = 15 and r % 9 = 5 then '[packages]' || chr(10) || 'requests = "*"' || chr(10) || '[dev-packages]' || chr(10) || 'pytest = "*"' || chr(10) || '[requires]' || chr(10) || 'python_version = "3"'
   when kind = 15 and r % 9 = 6 then '[tool.poetry.dependencies]' || chr(10) || 'flask = "2"' || chr(10) || 'q' || cast(file_seq % 7 as varchar(10)) || ' = "1"'
   when kind = 18 and r % 2 = 1 then '# pins' || chr(10) || 'django==4.2' || chr(10) || 'pkg' || cast(file_seq % 5 as varchar(10)) || '>=1.0' || chr(10) || 'tilde~=1.0' || chr(10)
   else case file_seq % 5 when 0 then '# note' when 1 then '// note' when 2 then '    import kafka'
     when 3 then 'class A uses postgres and boto3' else '                def f(): graphql' end
     || chr(10) || chr(10) || text end as content
 from (select *, JSON_FORMS(npm) as json_npm, JSON_FORMS(composer) as json_composer
       from (select source as repo, doc_id as file_seq, text, doc_id % 20 as r,
         cast(floor(doc_id / 20) as bigint) as k,
         (cast(floor(doc_id / 20) as bigint) + doc_id) % 20 as kind,
         '"dependencies":{"react":"18","lib' || cast(doc_id % 7 as varchar(10)) || '":"1"},"devDependencies":{"jest":"29","webpack":"5"}}' as npm,
         '"require":{"laravel/framework":"10","p' || cast(doc_id % 7 as varchar(10)) || '":"1"},"require-dev":{"phpunit":"1"}}' as composer
       from documents) a0) a
) b
)"""

def _json_forms(rest: str) -> str:
    """The forms of a JSON manifest; the column ``rest`` is its text behind the first brace."""
    first = {"npm": "dependencies", "composer": "require"}[rest]
    forms = [f"'{{' || {rest}", f"'{{\"{first}\":{{\"gone\":\"0\"}},' || {rest}", f"'{{' || {rest} || ' and more }}'",
             f"replace('{{' || {rest}, '\"', chr(39))", f"'{{' || left({rest}, -1)"]
    whens = " ".join(f"when {i} then {form}" for i, form in enumerate(forms))
    return f"(case (file_seq // 200) % 6 {whens} else '{{\"a}}b\":[{{\"c\":\"]\"}}],' || {rest} || chr(10) end)"


CORPUS = re.sub(r"JSON_FORMS\((\w+)\)", lambda m: _json_forms(m[1]), CORPUS)

FILES = f"""files as (
select repo, file_seq, path, {name('path')} as name, 'file' as type, size from corpus
)"""

CONTENTS = """contents as (select repo, path, file_seq, content from corpus)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


PRELUDE = with_ctes(CORPUS, FILES, CONTENTS)
