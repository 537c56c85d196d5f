"""Oracle SQL: for each registered query, an independent DuckDB statement over
the driver's tables (the corpus derivation is a CTE prelude)."""

from __future__ import annotations

from codecensus import rules
from codecensus.plans import sqlparts as P

SQL: dict[str, str] = {}


def oracle(name: str, body: str, ctes: tuple[str, ...] = ()) -> None:
    SQL[name] = P.with_ctes(P.CORPUS, P.FILES, P.CONTENTS, *ctes) + body


REL = f"rel as (select * from files where {P.filter_keep('path')})"
FLAGS = P.category_flags("path")
BFLAGS = P.basic_category_flags("path")
LANG = P.case_map(P.suffix("path"), rules.LANGUAGE_EXTENSIONS)
CODE_LANG = P.case_map(P.suffix("path"), rules.CODE_EXTENSIONS)

# ---------------------------------------------------------------- §2.2
oracle("with_path_parts", f"""
select repo, file_seq, name, {P.suffix('path')} as suffix, {P.directory('path')} as directory,
  cast(len(string_split(path, '/')) - 1 as integer) as depth, {P.parent('path')} as parent,
  cast(len(string_split(path, '/')) as integer) as n_parts
from files""")

oracle("filter_files", "select repo, file_seq, path, size from rel", (REL,))

oracle("with_priority_score", f"select repo, file_seq, path, {P.priority('path')} as priority from files")

oracle("limit_files", f"""
select repo, file_seq, path, priority,
  row_number() over (partition by repo order by priority desc, file_seq) as rank
from (select repo, file_seq, path, {P.priority('path')} as priority from rel) x""", (REL,))

oracle("detect_language", f"select repo, file_seq, {LANG} as language from files")

oracle("config_purpose", f"""
select * from (select repo, file_seq, name, {P.case_map('name', rules.CONFIG_FILES)} as purpose from files) x
where purpose is not null""")

oracle("classify_files", f"""
select repo, file_seq, {FLAGS['source']} as is_source, {FLAGS['test']} as is_test,
  {FLAGS['config']} as is_config, {FLAGS['documentation']} as is_documentation, {FLAGS['build']} as is_build
from rel""", (REL,))

oracle("classify_files_basic", f"""
select repo, file_seq, {BFLAGS['source']} as is_source, {BFLAGS['test']} as is_test,
  {BFLAGS['config']} as is_config, {BFLAGS['documentation']} as is_documentation, {BFLAGS['build']} as is_build
from contents""")

# ---------------------------------------------------------------- §2.3
oracle("structure_totals", """
select repo, count(*) as total_files, cast(sum(coalesce(size, 0)) as bigint) as total_size
from rel group by repo""", (REL,))

oracle("language_distribution", f"""
select repo, language, files, files / sum(files) over (partition by repo) * 100 as pct,
  cast(floor(20 * (files / sum(files) over (partition by repo) * 100) / 100) as integer) as bar_len
from (select repo, {LANG} as language, count(*) as files from rel
      where {LANG} is not null group by 1, 2) x""", (REL,))

oracle("extension_distribution", f"""
select repo, coalesce(nullif({P.suffix('path')}, ''), 'no_extension') as extension, count(*) as files
from rel group by 1, 2""", (REL,))

oracle("directory_listing", f"select repo, {P.directory('path')} as directory, file_seq, name from rel", (REL,))

oracle("directory_distribution", f"""
select repo, directory, files, rank from (
  select repo, directory, files,
    cast(row_number() over (partition by repo order by files desc, first_seq) as integer) as rank
  from (select repo, {P.directory('path')} as directory, count(*) as files, min(file_seq) as first_seq
        from rel group by 1, 2) a) b
where rank <= {rules.TOP_DIRECTORIES}""", (REL,))

oracle("depth_histogram", """
select repo, cast(len(string_split(path, '/')) - 1 as integer) as depth, count(*) as files
from rel group by 1, 2""", (REL,))

oracle("largest_files", f"""
select repo, rank, path, size from (
  select repo, path, coalesce(size, 0) as size,
    cast(row_number() over (partition by repo order by coalesce(size, 0) desc, file_seq) as integer) as rank
  from rel) x where rank <= {rules.TOP_LARGEST}""", (REL,))

_cat_union = " union all ".join(
    f"select repo, '{c}' as category, file_seq, path from rel where {FLAGS[c]}" for c in rules.CATEGORIES)
oracle("category_files", f"select * from ({_cat_union}) x", (REL,))
oracle("category_counts", f"""
select repo, category, count(*) as files from ({_cat_union}) x group by 1, 2""", (REL,))

oracle("structure_basic", "select repo, count(*) as total_files, cast(sum(length(content)) as bigint) as total_size, "
       + ", ".join(f"count(*) filter (where {BFLAGS[c]}) as {c}_files" for c in rules.CATEGORIES)
       + " from contents group by repo")

oracle("languages_basic", f"""
select repo, {CODE_LANG} as language, count(*) as files from contents
where {CODE_LANG} is not null group by 1, 2""")

oracle("largest_basic", f"""
select repo, rank, path, size from (
  select repo, path, cast(length(content) as bigint) as size,
    cast(row_number() over (partition by repo order by length(content) desc, file_seq) as integer) as rank
  from contents) x where rank <= {rules.TOP_LARGEST}""")

oracle("analysis_metadata", """
select f.repo, f.n as total_files_found, coalesce(r.n, 0) as files_analyzed,
  false as quick_analysis, true as include_file_contents, true as llm_analysis_enabled
from (select repo, count(*) as n from files group by repo) f
left join (select repo, count(*) as n from rel group by repo) r on f.repo = r.repo""", (REL,))

# ---------------------------------------------------------------- §2.5
RELC = f"relc as (select repo, path, file_seq, content from (select *, 'file' as type from corpus) x where {P.filter_keep('path')})"


def _comment_sql(lang: str, line: str) -> str:
    from codecensus.operators.metrics import comment_regex
    groups: dict[tuple, list[str]] = {}
    for lg, prefixes in rules.COMMENT_PREFIXES.items():
        groups.setdefault(tuple(prefixes), []).append(lg)
    whens = " ".join(f"when {lang} in {P.in_list(langs)} then regexp_matches({line}, {P.q(comment_regex(list(pre)))})"
                     for pre, langs in groups.items())
    return f"(case {whens} else regexp_matches({line}, {P.q(comment_regex(rules.DEFAULT_COMMENT_PREFIXES))}) end)"


BLANK = f"regexp_matches(l, {P.q('^' + P.WS_SQL + '*$')})"
FM = (
    f"fm0 as (select repo, path, file_seq, {LANG} as language, string_split(content, chr(10)) as ls from relc "
    f"where {LANG} is not null and length(content) > 0)",
    f"fm1 as (select *, list_filter(ls, lambda l: not {BLANK}) as nb from fm0)",
    f"fm2 as (select *, list_filter(nb, lambda l: {_comment_sql('language', 'l')}) as cm from fm1)",
    "fm as (select repo, path, file_seq, language, cast(len(ls) as bigint) as lines, "
    "cast(len(ls) - len(nb) as bigint) as blank_lines, cast(len(cm) as bigint) as comment_lines, "
    "cast(len(nb) - len(cm) as bigint) as code_lines, "
    f"cast(coalesce(floor(list_max(list_transform(nb, lambda l: length(regexp_extract(l, {P.q('^' + P.WS_SQL + '*')}, 0)))) "
    "/ (case when language = 'Python' then 4 else 2 end)), 0) as integer) as max_indentation from fm2)",
)
oracle("file_metrics", "select * from fm", (RELC,) + FM)
oracle("file_metrics_by_pieces", "select * from fm", (RELC,) + FM)
oracle("max_indentation", "select repo, path, file_seq, language, max_indentation from fm", (RELC,) + FM)


def _pct(part: str, total: str) -> str:
    return f"(case when {total} > 0 then cast({part} as double) / {total} * 100 else 0.0 end)"


oracle("code_metrics_totals", f"""
select *, {_pct('code_lines', 'total_lines')} as code_pct, {_pct('comment_lines', 'total_lines')} as comment_pct,
  {_pct('blank_lines', 'total_lines')} as blank_pct
from (select repo, cast(sum(lines) as bigint) as total_lines, cast(sum(code_lines) as bigint) as code_lines,
        cast(sum(comment_lines) as bigint) as comment_lines, cast(sum(blank_lines) as bigint) as blank_lines,
        count(*) as files_analyzed from fm group by repo) t""", (RELC,) + FM)

SQL["stream_replaced_totals"] = SQL["code_metrics_totals"]

oracle("code_metrics_by_language", """
select repo, language, count(*) as files, cast(sum(lines) as bigint) as lines,
  cast(sum(code_lines) as bigint) as code_lines, cast(sum(comment_lines) as bigint) as comment_lines
from fm group by 1, 2""", (RELC,) + FM)

oracle("large_files", "select repo, path, file_seq, lines from fm where lines > 40", (RELC,) + FM)
oracle("deeply_nested_files",
       f"select repo, path, file_seq, max_indentation from fm where max_indentation > {rules.DEEP_NESTING_LEVEL}",
       (RELC,) + FM)

COLLECTED = (f"collected as (select * from contents where {CODE_LANG} is not null "
             f"or lower({P.name('path')}) in {P.in_list(rules.COLLECT_EXTRA_NAMES)})")
SPLITLINES_SQL = ("(case when ls[-1] = '' then ls[1:len(ls) - 1] else ls end)")
BASIC = (
    COLLECTED,
    f"b0 as (select repo, coalesce({CODE_LANG}, 'Unknown') as language, "
    f"regexp_split_to_array(content, {P.q(__import__('codecensus.operators.metrics', fromlist=['x']).SPLITLINES)}) as ls from collected)",
    f"b1 as (select repo, language, {SPLITLINES_SQL} as ls from b0)",
    f"b2 as (select *, list_filter(ls, lambda l: not {BLANK}) as nb from b1)",
    f"b3 as (select *, list_filter(nb, lambda l: regexp_matches(l, {P.q('^' + P.WS_SQL + '*(?:#|//)')})) as cm from b2)",
)
oracle("code_metrics_basic", """
select repo, language, count(*) as files, cast(sum(len(ls)) as bigint) as lines,
  cast(sum(len(nb) - len(cm)) as bigint) as code_lines, cast(sum(len(cm)) as bigint) as comment_lines
from b3 group by 1, 2""", BASIC)

RESPONSES = r"""responses as (
select repo, path, file_seq, case when file_seq % 11 = 0 then
 case (file_seq // 11) % 8 when 0 then 'No JSON here' || chr(10) || path when 1 then 'The code uses {braces} in ' || path
  when 2 then '{ ' || chr(10) || 'First line of ' || path || chr(10) || '{not json}' when 3 then 'Cut {"summary": "s", "x": } for ' || path
  when 4 then '{''summary'': ''single quotes in ' || path || '''}' when 5 then '{"summary":"' || path || '"} and }'
  when 6 then '{"summary":"one"} {"summary":"' || path || '"}' else 'for (;;) { x = 1; }' || chr(10) || path end
 else 'Here: {' || case when file_seq % 13 = 3 then '"summary":"Old","code_patterns":"none","dependencies":[{"x":1},"gone"],' else '' end
 || '"summary":"S' || cast(file_seq as varchar(20)) || ' ' || md5(text) || '",'
 || case when file_seq % 2 = 0 then '"main_functionality":"' || regexp_replace(text, '[^A-Za-z ]+', '', 'g') || '",' else '' end
 || '"complexity_assessment":"'
 || case file_seq % 3 when 0 then 'Simple. ok' when 1 then 'Moderate - x' else 'Complex' end
 || '","key_components":["part ' || cast(file_seq % 5 as varchar(10)) || '","core"],"dependencies":["dep' || cast(file_seq % 9 as varchar(10)) || '","json"],"code_patterns":["P'
 || cast(file_seq % 4 as varchar(10)) || '"' || case when file_seq % 6 = 0 then ',"A|B"' else '' end
 || '],"improvement_suggestions":["'
 || case file_seq % 4 when 0 then 'Add unit tests' when 1 then 'Improve error handling'
    when 2 then 'Optimize performance' else 'Refactor names' end || '"'
 || case when file_seq % 10 = 5 then ',{"description":"Cache ' || cast(file_seq % 7 as varchar(10)) || '"}'
    when file_seq % 15 = 0 then ',{"text":"Old","text":"Split test ' || cast(file_seq % 7 as varchar(10)) || '"}'
    when file_seq % 5 = 0 then ',{"text":"Split part ' || cast(file_seq % 7 as varchar(10)) || '"}' else '' end
 || ']} done' end as response,
 case when file_seq % 17 = 0 then 'LLM API error: timeout' end as error
from corpus
where path like '%.py' or path like '%.js' or path like '%.go' or path like '%.rs' or path like '%.java'
)"""

oracle("content_volume", f"""
select r.repo, r.files_retrieved, coalesce(a.n, 0) as files_analyzed, r.total_chars,
  {_pct('coalesce(a.n, 0)', 'r.files_retrieved')} as coverage_pct,
  case when coalesce(a.n, 0) > 0 then r.total_chars / coalesce(a.n, 0) end as avg_chars_per_file
from (select repo, count(*) as files_retrieved, cast(sum(length(content)) as bigint) as total_chars
      from collected group by repo) r
left join (select repo, count(*) as n from responses group by repo) a on r.repo = a.repo""",
       (COLLECTED, RESPONSES))

# ---------------------------------------------------------------- §2.1
oracle("read_listing", "select repo, file_seq, path, name, type, size, fmt from files, "
       "(values ('parquet'), ('json')) f(fmt)")

oracle("normalize_ado_listing", "select repo, cast(floor(file_seq / 50) as bigint) as page, path, size from corpus")

_pages = "select repo, cast(floor(file_seq / 50) as bigint) as page, path, size, '{}' as scope from corpus where {}"
oracle("listing_pages", " union all ".join(_pages.format(scope, cond) for scope, cond in (
    ("all", "true"), ("src3", "repo = 'src3'"), ("pages 2 to 8", "file_seq // 50 between 2 and 8"))))

oracle("landed_tree", f"""
select 'repo=' || repo as repo, 'language=' || language as directory,
  row_number() over (partition by repo order by 'language=' || language || '/') as file_seq, 'file' as type,
  cast(sum(octet_length(encode(path)) + 1) as bigint) as size
from (select repo, path, replace(coalesce({LANG}, 'none'), '/', '%2F') as language from files) x group by repo, language""")

oracle("listing_counts", f"""
select f.repo, f.n as file_count, coalesce(d.n, 0) as folder_count
from (select repo, count(*) as n from corpus group by repo) f
left join (select repo, count(*) filter (where regexp_extract(dir, '([^/]*)$', 1) <> 'assets') as n
           from (select distinct repo, {P.directory('path')} as dir from corpus where contains(path, '/')) x
           group by repo) d on f.repo = d.repo""")

oracle("decode_contents", """
select repo, file_seq, 'drop' as mode, md5(content) as content_md5 from contents where file_seq % 13 <> 0
union all select repo, file_seq, 'ignore', md5(case when file_seq % 13 = 0 then content || chr(65533) || chr(1114110) else content end)
  from contents
union all select repo, file_seq, 'latin1', md5(case when file_seq % 13 = 0 then
    array_to_string(list_transform(string_split(regexp_replace(hex(encode(content)), '(..)', '\\1 ', 'g'), ' ')[1:-2],
      lambda x: chr(cast('0x' || x as integer))), '') || 'ï¿½ô' || chr(143) || '¿¾ÿ' else content end)
  from contents""")

oracle("collect_code_files", """
select repo, count(*) as collected_files, cast(sum(length(content)) as bigint) as total_size
from collected group by repo""", (COLLECTED,))

oracle("retrieve_capped", f"""
select repo, file_seq, row_number() over (partition by repo order by file_seq) as rank
from corpus where {CODE_LANG} is not null""")

oracle("files_by_extension", f"""
select repo, extension, files, total_chars, coalesce({P.case_map('extension', rules.CODE_EXTENSIONS)}, 'Unknown') as language
from (select repo, {P.suffix('path')} as extension, count(*) as files, cast(sum(length(content)) as bigint) as total_chars
      from collected group by 1, 2) x""", (COLLECTED,))

PR = "pr as (select distinct lang as project, source as repo from documents)"
URLS = """urls as (
select 'https://github.com/' || project || '/' || repo as url from pr
union all select 'https://github.com/' || project || '/widget' || repo || '.git/' from pr
union all select project || '/' || repo from pr
union all select project || '/' || repo || '/x' from pr
union all select 'https://dev.azure.com/org/' || project || '/_git/' || repo from pr
union all select 'https://org' || project || '.visualstudio.com/' || project || '/_git/' || repo || '/' from pr
union all select url from pages)"""
GH_RE, ADO_RE, ADO_OLD_RE = (r"^https://github\.com/([^/]+)/([^/]+)", r"^https://dev\.azure\.com/([^/]+)/([^/]+)/_git/([^/]+)",
                             r"^https://([^.]+)\.visualstudio\.com/([^/]+)/_git/([^/]+)")
oracle("parse_repo_url", f"""
select url, platform,
  case when ado then regexp_extract(url, {P.q(ADO_RE)}, 1) when ado_old then regexp_extract(url, {P.q(ADO_OLD_RE)}, 1)
       when platform = 'github' then split_part(repo_path, '/', 1) end as owner,
  case when ado then regexp_extract(url, {P.q(ADO_RE)}, 2) when ado_old then regexp_extract(url, {P.q(ADO_OLD_RE)}, 2) end as project,
  case when ado then regexp_extract(url, {P.q(ADO_RE)}, 3) when ado_old then regexp_extract(url, {P.q(ADO_OLD_RE)}, 3)
       when platform = 'github' then (case when starts_with(url, 'https://github.com/') and gh_raw <> ''
            then regexp_replace(gh_raw, '\\.git$', '') else split_part(repo_path, '/', 2) end) end as repo_name,
  case when platform = 'github' then repo_path end as repo_path,
  case when platform is not null then null when repo_path is null then 'Invalid repository URL format: ' || url
       else 'Invalid repository path format: ' || repo_path end as error
from (select *, case when ado then 'azure_devops' when ado_old then 'azure_devops'
                     when repo_path is not null and length(repo_path) - length(replace(repo_path, '/', '')) = 1 then 'github' end as platform
      from (select url,
              case when starts_with(url, 'https://github.com/') then regexp_replace(replace(url, 'https://github.com/', ''), '/+$', '')
                   when contains(url, '/') and not starts_with(url, 'http') then url end as repo_path,
              regexp_extract(url, {P.q(ADO_RE)}, 1) <> '' as ado,
              regexp_extract(url, {P.q(ADO_OLD_RE)}, 1) <> '' as ado_old,
              regexp_extract(url, {P.q(GH_RE)}, 2) as gh_raw
            from urls) a) b""", (PR, URLS))

PER_LANG = (f"per_lang as (select repo, {LANG} as language, cast(sum(size) as bigint) as bytes from corpus "
            f"where {LANG} is not null group by 1, 2)")
REPOS = """repos as (
select b.repo, 'Corpus repository ' || b.repo as description, 'https://github.com/org/' || b.repo as url,
  l.language, cast(b.seq_sum % 5000 as bigint) as stars, cast(b.n % 300 as bigint) as forks,
  cast(floor(b.bytes / 1024) as bigint) as size,
  strftime(timestamp '2020-01-01 00:00:00' + to_days(cast(b.r as integer)), '%Y-%m-%d') as created,
  strftime(timestamp '2020-01-01 00:00:00' + to_days(cast(b.r * 30 as integer)), '%Y-%m-%d') as updated,
  'analytics, group' || cast(b.r % 3 as varchar) as topics,
  case when b.r % 4 = 0 then null else 'MIT License' end as license,
  b.r % 2 = 0 as has_issues, b.r % 3 = 0 as has_projects, b.r % 5 <> 0 as has_wiki
from (select repo, min(r) as r, sum(file_seq) as seq_sum, count(*) as n, sum(size) as bytes from corpus group by repo) b
left join (select repo, first(language order by bytes desc, language desc) as language from per_lang group by repo) l
  on b.repo = l.repo)"""
oracle("repo_overview", """
select repo, repo as name, description, url, coalesce(language, 'Not specified') as language, stars, forks,
  size as size_kb, created, updated, topics, license, has_issues, has_projects, has_wiki from repos""",
       (PER_LANG, REPOS))

oracle("repo_overview_ado", """
select b.repo, b.repo as name, case when p.license is null then 'Unknown' else 'group' || cast(b.r % 3 as varchar) end as project,
  p.size, case when p.has_wiki then 'main' else 'Unknown' end as default_branch
from (select repo, min(r) as r from corpus group by repo) b join repos p on b.repo = p.repo""", (PER_LANG, REPOS))

oracle("language_bytes_share", f"""
select repo, rank, language, bytes, pct from (
  select repo, language, bytes, bytes / sum(bytes) over (partition by repo) * 100 as pct,
    cast(row_number() over (partition by repo order by bytes desc, language) as integer) as rank
  from per_lang) x where rank <= {rules.TOP_LANGUAGE_BYTES}""", (PER_LANG,))

COMMITS = """commits as (
select 'src' || cast(o_custkey % 20 as varchar) as repo, md5(cast(o_orderkey as varchar)) as sha,
  o_orderpriority || chr(10) || 'body' as message, cast(o_custkey as varchar) as author, o_orderdate as date,
  'https://github.com/org/src' || cast(o_custkey % 20 as varchar) || '/commit/' || md5(cast(o_orderkey as varchar)) as url,
  o_orderpriority as branch
from orders)"""
oracle("recent_commits", f"""
select repo, rank, substr(sha, 1, 8) as sha, split_part(message, chr(10), 1) as message, author,
  strftime(date, '%Y-%m-%d %H:%M:%S') as date, url
from (select *, cast(row_number() over (partition by repo order by date desc, sha) as integer) as rank from commits) x
where rank <= {rules.RECENT_COMMITS}""", (COMMITS,))

oracle("commits_on_branch", """
select repo, branch, row_number() over (partition by repo order by date desc, sha) as rank, sha,
  split_part(message, chr(10), 1) as message, count(*) over (partition by repo) as count
from commits where branch = '1-URGENT'""", (COMMITS,))

PRS = """prs as (
select 'src' || cast(o_custkey % 20 as varchar) as repo, o_orderkey as pr_id, 'Order ' || cast(o_orderkey as varchar) as title,
  case o_orderstatus when 'O' then 'active' when 'F' then 'completed' else 'abandoned' end as status
from orders)"""
oracle("pull_requests_by_status", """
select repo, row_number() over (partition by repo order by pr_id desc) as rank, pr_id, title, status,
  count(*) over (partition by repo) as count, 'active' as scope from prs where status = 'active'
union all
select repo, row_number() over (partition by repo order by pr_id desc) as rank, pr_id, title, status,
  count(*) over (partition by repo) as count, 'all' as scope from prs""", (PRS,))

oracle("branches_per_repo", """
select repo, branch, row_number() over (partition by repo order by branch) as rank,
  count(*) over (partition by repo) as count from (select distinct repo, branch from commits) d""", (COMMITS,))

oracle("list_org_repositories", """
select project, repo, count(*) over (partition by project) as count, 'all' as scope from pr
union all select project, repo, count(*) over () as count, 'de' as scope from pr where project = 'de'""", (PR,))

_owned = "select 'org' || cast(file_seq % 3 as varchar) || '/' || repo as repo, path, file_seq, content from contents"
oracle("search_code_index", " union all ".join(
    f"select repo, path, file_seq, '{scope}' as scope from ({_owned}) x where contains(lower(content), '{text}') and {cond}"
    for scope, text, cond in (("everywhere", "kafka", "true"), ("owner", "kafka", "starts_with(repo, 'org1/')"),
                              ("repository", "kafka", "repo = 'org2/src3'"), ("short", "kq", "true"))))

oracle("search_code", """
select repo, path, file_seq, 'everywhere' as scope from contents where contains(lower(content), 'kafka')
union all select 'org1/' || repo, path, file_seq, 'owner' from contents
  where contains(lower(content), 'kafka') and file_seq % 3 = 1
union all select 'org2/' || repo, path, file_seq, 'repository' from contents
  where contains(lower(content), 'kafka') and file_seq % 3 = 2 and repo = 'src3'""")

# ---------------------------------------------------------------- §2.6
from codecensus.operators.patterns import TERMS, FLAG_OF  # noqa: E402


def _flag_aggs() -> str:
    lc = "lower(coalesce(content, ''))"
    n = P.name("path")
    par = P.parent("path")
    raw_suffix = f"regexp_extract({n}, '^.+(\\.[^.]+)$', 1)"
    items = [f"bool_or(contains({lc}, {P.q(t)})) as {FLAG_OF[t]}" for t in TERMS]
    items += [
        f"bool_or({n} = 'package.json') as has_package_json",
        f"bool_or(path = 'package.json' and {P.contains_any(lc, rules.FRONTEND_MARKERS)}) as pkg_frontend",
        f"bool_or(path = 'package.json' and {P.contains_any(lc, rules.BACKEND_MARKERS)}) as pkg_backend",
        f"bool_or({n} in {P.in_list(rules.PYTHON_MANIFESTS)}) as has_python_manifest",
        f"bool_or({n} in {P.in_list(rules.MOBILE_MANIFESTS)}) as has_mobile_manifest",
        f"bool_or({n} in {P.in_list(rules.JAVA_MANIFESTS)}) as has_java_manifest",
        *[f"bool_or({n} = {P.q(f)}) as has_{i}" for i, (f, _) in enumerate(rules.SINGLE_MANIFEST_TYPES)],
        f"bool_or({n} in {P.in_list(rules.CONTAINER_FILES)}) as has_container",
        f"bool_or({raw_suffix} in {P.in_list(rules.DOC_SITE_SUFFIXES)}) as has_doc_suffix",
        f"count(*) filter (where {raw_suffix} in {P.in_list(rules.DOC_SITE_CODE_SUFFIXES)}) as n_code_suffix",
        *[f"bool_or({par} in {P.in_list(d)}) as arch_dir_{i}" for i, (_, d) in enumerate(rules.ARCHITECTURE_DIR_RULES)],
        f"bool_or({n} = {P.q(rules.MICROSERVICES_FILE)}) as has_compose",
        f"bool_or({n} in {P.in_list(rules.API_FIRST_FILES)}) as has_api_spec",
    ]
    return ", ".join(items)


FLAGS_CTE = f"flags as (select repo, {_flag_aggs()} from relc group by repo)"


def _any_sql(terms) -> str:
    return "(" + " or ".join(FLAG_OF[t] for t in terms) + ")"


def _project_type_sql() -> str:
    py = " ".join(f"when {FLAG_OF[t]} then {P.q(lb)}" for t, lb in rules.PYTHON_WEB_RULES)
    singles = " ".join(f"when has_{i} then {P.q(lb)}" for i, (_, lb) in enumerate(rules.SINGLE_MANIFEST_TYPES))
    return ("(case when has_package_json then (case when pkg_frontend then 'Frontend Web Application' "
            "when pkg_backend then 'Backend Web Application' else 'Node.js Application' end) "
            f"when has_python_manifest then (case {py} else 'Python Application' end) "
            "when has_mobile_manifest then 'Mobile Application' when has_java_manifest then 'Java Application' "
            f"{singles} when has_container then 'Containerized Application' "
            f"when has_doc_suffix and n_code_suffix < {rules.DOC_SITE_MAX_CODE_FILES} then 'Documentation/Static Site' "
            "else 'Unknown' end)")


def _api_sql() -> str:
    return "(case " + " ".join(f"when {_any_sql(ts)} then {P.q(lb)}" for lb, ts in rules.API_TYPE_RULES) + " end)"


def _arch_items() -> list[tuple[str, str]]:
    out = []
    for i, (lb, _) in enumerate(rules.ARCHITECTURE_DIR_RULES):
        cond = f"arch_dir_{i}" + (" or has_compose" if i == 1 else "")
        out.append((f"({cond})", lb))
    out += [("has_api_spec", "API-First Design"), (_any_sql(rules.EVENT_WORDS), "Event-Driven Architecture")]
    return out


def _ordered_union(items: list[tuple[str, str]], extra_cols: str = "") -> str:
    """Rows (repo, pos, value) for the true conditions, numbered in order."""
    parts = " union all ".join(f"select repo, {i} as k, {P.q(lb)} as v{extra_cols} from flags where {cond}"
                               for i, (cond, lb) in enumerate(items))
    return parts


oracle("detect_project_type", f"select repo, {_project_type_sql()} as project_type from flags", (RELC, FLAGS_CTE))
oracle("detect_api_type", f"select repo, {_api_sql()} as api_type from flags", (RELC, FLAGS_CTE))
oracle("detect_architecture", f"""
select repo, cast(row_number() over (partition by repo order by k) - 1 as integer) as pos, v as pattern
from ({_ordered_union(_arch_items())}) x""", (RELC, FLAGS_CTE))

_tech_parts = []
for _cat, _group in rules.TECHNOLOGY_GROUPS:
    for _i, (_tech, _pats) in enumerate(_group.items()):
        _tech_parts.append(f"select repo, {P.q(_cat)} as category, {_i} as k, {P.q(_tech)} as technology "
                           f"from flags where {_any_sql(_pats)}")
oracle("detect_technologies", f"""
select repo, category, cast(row_number() over (partition by repo, category order by k) - 1 as integer) as pos, technology
from ({' union all '.join(_tech_parts)}) x""", (RELC, FLAGS_CTE))


def _joined(items: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {c} then {P.q(lb)} end" for c, lb in items) + ")"


oracle("project_patterns", "select repo, " + _project_type_sql() + " as project_type, " + _api_sql() + " as api_type, "
       + _joined(_arch_items()) + " as architecture_patterns, "
       + ", ".join(_joined([(_any_sql(p), t) for t, p in g.items()]) + f" as {cat}" for cat, g in rules.TECHNOLOGY_GROUPS)
       + " from flags", (RELC, FLAGS_CTE))

# ---------------------------------------------------------------- §2.4
from codecensus.operators.dependencies import MANIFESTS  # noqa: E402

WSQ = P.WS_SQL


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {P.q('^' + WSQ + '+|' + WSQ + '+$')}, '', 'g')"


def _slines(x: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')})"


def _rows(manager: str, scope: str, lst: str, where: str) -> str:
    return (f"select repo, path, file_seq, {P.q(manager)} as manager, {P.q(scope)} as scope, "
            f"cast(s.pos as integer) as pos, s.package as package from (select repo, path, file_seq, "
            f"unnest(list_transform({lst}, lambda x, i: {{'pos': i - 1, 'package': x}})) as s from man "
            f"where {where}) u")


def _object_keys(field: str) -> str:
    """Keys of the last object of that name."""
    return f"json_keys(list_filter(list_zip(json_keys(content), json_extract(content, '$.*')), lambda x: x[1] = '{field}')[-1][2])"


MAN = f"man as (select *, {P.name('path')} as name from relc where {P.name('path')} in {P.in_list(MANIFESTS)})"
_dep_parts = [
    _rows("npm", "prod", _object_keys("dependencies"), "name = 'package.json' and json_valid(content)"),
    _rows("npm", "dev", _object_keys("devDependencies"), "name = 'package.json' and json_valid(content)"),
    _rows("composer", "prod", _object_keys("require"), "name = 'composer.json' and json_valid(content)"),
    _rows("composer", "dev", _object_keys("require-dev"), "name = 'composer.json' and json_valid(content)"),
    _rows("pip", "prod",
          "list_filter(list_transform(list_filter(list_transform(string_split(" + _strip("content")
          + ", chr(10)), lambda l: " + _strip("l") + "), lambda l: l <> '' and not starts_with(l, '#')), "
          "lambda l: " + _strip("regexp_extract(l, '^[^><=!]*', 0)") + "), lambda p: p <> '')",
          "name = 'requirements.txt'"),
    _rows("poetry", "prod", "regexp_extract_all(content, '(\\w+)\\s*=', 1)", "name = 'pyproject.toml'"),
    _rows("go", "prod", "list_filter(list_transform(list_filter(" + _slines("content")
          + ", lambda l: starts_with(l, 'require ')), lambda l: regexp_split_to_array(l, "
          + P.q(WSQ + "+") + ")[2]), lambda m: m is not null)", "name = 'go.mod'"),
    _rows("maven", "prod", "regexp_extract_all(content, '<artifactId>([^<]+)</artifactId>', 1)", "name = 'pom.xml'"),
    _rows("bundler", "prod", "list_filter(list_transform(list_filter(" + _slines("content")
          + ", lambda l: starts_with(l, 'gem ')), lambda l: regexp_extract(l, "
          + P.q("gem" + WSQ + "+['\"]([^'\"]+)['\"]") + ", 1)), lambda n: n <> '')", "name = 'Gemfile'"),
]
PIPENV = f"""select repo, path, file_seq, 'pipenv' as manager, scope,
  cast(row_number() over (partition by repo, path, scope order by idx) - 1 as integer) as pos,
  regexp_replace({_strip("split_part(line, '=', 1)")}, '^"+|"+$', '', 'g') as package
from (select *, case sec when 'packages' then 'prod' when 'dev-packages' then 'dev' end as scope
      from (select *, last_value(hdr ignore nulls) over (partition by repo, path order by idx
                 rows between unbounded preceding and current row) as sec
            from (select repo, path, file_seq, idx, line,
                    case when starts_with(line, '[packages]') then 'packages'
                         when starts_with(line, '[dev-packages]') then 'dev-packages'
                         when starts_with(line, '[') then 'none' end as hdr
                  from (select repo, path, file_seq, unnest(ls) as line, unnest(range(len(ls))) as idx
                        from (select *, {_slines('content')} as ls from man where name = 'Pipfile') a) b) c) d) e
where scope is not null and not starts_with(line, '[') and contains(line, '=')"""
DEPS = "deps as (" + " union all ".join(_dep_parts + [PIPENV]) + ")"
DEP_CTES = (RELC, MAN, DEPS)

oracle("extract_dependencies", "select * from deps", DEP_CTES)

_mgr_case = "(case " + " ".join(f"when name = {P.q(n)} then {P.q(m)}" for n, (m, _) in MANIFESTS.items()) + " end)"
oracle("package_managers", f"""
select repo, path, file_seq, {_mgr_case} as manager from man
where name not in ('package.json', 'composer.json') or json_valid(content)""", (RELC, MAN))

oracle("package_managers_basic", " union all ".join(
    f"select repo, cast(row_number() over (partition by repo order by k) - 1 as integer) as pos, manager from ("
    + " union all ".join(f"select repo, {i} as k, {P.q(m)} as manager from collected group by repo "
                         f"having bool_or(ends_with(lower(path), {P.q(sfx)}))"
                         for i, (m, sfx) in enumerate(rules.BASIC_MANAGERS)) + ") x"
    for _ in [0]), (COLLECTED,))

oracle("dependency_totals", """
select repo, scope, manager, count(*) as dependencies from deps
group by rollup (repo, scope, manager) having repo is not null""", DEP_CTES)

oracle("top_dependencies", f"""
select t.repo, t.scope, t.manager, t.rank, t.package, c.total,
  greatest(c.total - (case when t.scope = 'prod' then {rules.PROD_DEPS_SHOWN} else {rules.DEV_DEPS_SHOWN} end), 0) as more
from (select *, cast(row_number() over (partition by repo, scope, manager order by file_seq, pos) as integer) as rank
      from deps) t
join (select repo, scope, manager, count(*) as total from deps group by 1, 2, 3) c
  on t.repo = c.repo and t.scope = c.scope and t.manager = c.manager
where t.rank <= (case when t.scope = 'prod' then {rules.PROD_DEPS_SHOWN} else {rules.DEV_DEPS_SHOWN} end)""",
       DEP_CTES)

_tool_rows = []
for _grp, _table in rules.TOOLING_GROUPS:
    for _ti, (_tool, _pats) in enumerate(_table.items()):
        _cond = " or ".join(f"contains(lower(package), {P.q(p.lower())})" for p in _pats)
        _tool_rows.append(f"select repo, file_seq, case when scope = 'prod' then 0 else 1 end as sr, pos, "
                          f"{_ti} as ti, {P.q(_grp)} as category, {P.q(_tool)} as tool from deps "
                          f"where manager = 'npm' and ({_cond})")
oracle("identify_tooling", f"""
select repo, category,
  cast(row_number() over (partition by repo, category order by f, s, p, t) as integer) as rank, tool
from (select repo, category, tool, arg_min(file_seq, (file_seq, sr, pos, ti)) as f, arg_min(sr, (file_seq, sr, pos, ti)) as s,
        arg_min(pos, (file_seq, sr, pos, ti)) as p, arg_min(ti, (file_seq, sr, pos, ti)) as t
      from ({' union all '.join(_tool_rows)}) h group by 1, 2, 3) x""", DEP_CTES)

# ---------------------------------------------------------------- §2.7
NLINES = "len(string_split(content, chr(10)))"
_kclass = (f"(case when lower({P.name('path')}) in {P.in_list(rules.KEY_MAIN_NAMES)} then 'main' "
           f"when lower({P.name('path')}) in {P.in_list(rules.KEY_CONFIG_NAMES)} then 'config' "
           f"when {P.contains_any('lower(' + P.name('path') + ')', rules.KEY_CORE_WORDS)} then 'core' "
           f"when {P.contains_any('lower(' + P.name('path') + ')', rules.KEY_API_WORDS)} then 'api' end)")
_kidx = "(case kind " + " ".join(f"when {P.q(c)} then {i}" for i, (c, _) in enumerate(rules.KEY_QUOTAS)) + " end)"
_kquota = "(case kind " + " ".join(f"when {P.q(c)} then {q}" for c, q in rules.KEY_QUOTAS) + " end)"
KF = (
    f"kn as (select repo, path, file_seq as seq, {_kclass} as kind, "
    f"{P.suffix('path')} in {P.in_list(rules.KEY_EXTRA_SUFFIXES)} as extra_ok, "
    f"coalesce({NLINES}, 1) as lines, content is not null as has_text from relc)",
    f"chosen as (select repo, path, seq, kind, rk, has_text, {_kidx} as k from "
    f"(select *, row_number() over (partition by repo, kind order by seq) as rk from kn where kind is not null) a "
    f"where rk <= {_kquota})",
    f"extra as (select repo, path, seq, 'extra' as kind, rk, has_text, {len(rules.KEY_QUOTAS)} as k from "
    f"(select *, row_number() over (partition by repo order by abs(lines - {rules.KEY_EXTRA_TARGET_LINES}), seq) as rk "
    f"from kn where extra_ok and not exists (select 1 from chosen c where c.repo = kn.repo and c.path = kn.path)) b "
    f"where rk <= {rules.KEY_EXTRA_COUNT})",
)
oracle("key_files", """
select repo, cast(row_number() over (partition by repo order by k, rk) as integer) as pos, path, kind
from (select * from chosen union all select * from extra) u where has_text""", (RELC,) + KF)


def _sel_score() -> str:
    ln = f"lower({P.name('path')})"
    lc = "lower(content)"
    parts = [
        (f"coalesce(is_focus, false)", rules.SEL_FOCUS),
        (f"{ln} in {P.in_list(rules.SEL_MAIN_NAMES)}", rules.SEL_MAIN),
        (P.contains_any(ln, rules.SEL_CORE_WORDS), rules.SEL_CORE),
        (f"{ln} in {P.in_list(rules.SEL_CONFIG_NAMES)}", rules.SEL_CONFIG),
        (P.contains_any(ln, rules.SEL_UTIL_WORDS), rules.SEL_UTIL),
        (P.contains_any(ln, rules.SEL_API_WORDS), rules.SEL_API),
        (P.contains_any(ln, rules.SEL_MODEL_WORDS), rules.SEL_MODEL),
        (P.contains_any(ln, rules.SEL_TEST_WORDS), rules.SEL_TEST),
        (f"{CODE_LANG} is not null", rules.SEL_CODE_EXT),
        (P.contains_any(lc, rules.SEL_KEYWORDS), rules.SEL_KEYWORD),
        ("not contains(path, '/')", rules.SEL_ROOT),
    ]
    s = " + ".join(f"(case when {c} then {p} else 0 end)" for c, p in parts)
    (lo1, hi1, p1), (lo2, hi2, p2) = rules.SEL_SIZE_BANDS
    n = NLINES
    s += (f" + (case when {n} between {lo1} and {hi1} then {p1} when {n} between {lo2} and {hi2} then {p2} "
          f"when {n} > {hi2} then {rules.SEL_SIZE_LARGE} else 0 end)")
    return "(" + s + ")"


def _reduced_score() -> str:
    ln = f"lower({P.name('path')})"
    parts = [
        ("coalesce(is_focus, false)", rules.SEL_FOCUS),
        (f"{ln} in {P.in_list(rules.SEL_MAIN_NAMES)}", rules.SEL_MAIN),
        (P.contains_any(ln, rules.SEL_CORE_WORDS), rules.SEL_CORE),
        (P.contains_any(ln, rules.SEL_API_WORDS), rules.SEL_API),
        (f"{CODE_LANG} is not null", rules.SEL_CODE_EXT),
        ("not contains(path, '/')", rules.SEL_ROOT),
    ]
    return "(" + " + ".join(f"(case when {c} then {p} else 0 end)" for c, p in parts) + ")"


FOCUS = "focus as (select distinct repo, path, true as is_focus from corpus where kind = 5)"
FJ = ("fj as (select r.repo, r.path, r.file_seq, r.content, f.is_focus from relc r left join focus f "
      "on r.repo = f.repo and r.path = f.path)")
SEL = (FOCUS, FJ,
       f"selected as (select * from (select repo, path, file_seq, score, "
       f"cast(row_number() over (partition by repo order by score desc, file_seq) as integer) as rank from "
       f"(select repo, path, file_seq, {_sel_score()} as score from fj where {CODE_LANG} is not null "
       f") s) t where rank <= {rules.MAX_FILES_FOR_ANALYSIS})")
oracle("select_for_analysis", "select repo, rank, path, file_seq, score from selected", (RELC,) + SEL)

oracle("selection_scores", f"""
select t.repo, t.rank, t.path, t.score, coalesce(s.sel, false) as selected, n.total_files,
  coalesce(m.selected_files, 0) as selected_files
from (select * from (select repo, path, file_seq, score,
        cast(row_number() over (partition by repo order by score desc, file_seq) as integer) as rank
      from (select repo, path, file_seq, {_reduced_score()} as score from fj) a) b
      where rank <= {rules.SELECTION_SHOWN}) t
left join (select repo, path, true as sel from selected) s on t.repo = s.repo and t.path = s.path
join (select repo, count(*) as total_files from relc group by repo) n on t.repo = n.repo
left join (select repo, count(*) as selected_files from selected group by repo) m on t.repo = m.repo""",
       (RELC,) + SEL)

_imp = (f"(case when lower({P.name('path')}) in {P.in_list(rules.ORDER_MAIN_NAMES)} then 1 "
        f"when lower({P.name('path')}) in {P.in_list(rules.ORDER_CONFIG_NAMES)} then 2 "
        f"when {P.contains_any('lower(' + P.name('path') + ')', rules.ORDER_CORE_WORDS)} then 3 "
        f"when {P.contains_any('lower(' + P.name('path') + ')', rules.ORDER_API_WORDS)} then 4 else 5 end)")
oracle("report_file_order", f"select repo, path, {_imp} as importance, file_seq as order_key from responses",
       (RESPONSES,))

# ---------------------------------------------------------------- §2.8
_tpl = rules.PROMPT_TEMPLATE
_a, _rest = _tpl.split("{language}", 1)
_b, _rest = _rest.split("{file_path}", 1)
_c, _rest = _rest.split("{language_lower}", 1)
_d, _e = _rest.split("{content}", 1)


def _sqltext(t: str) -> str:
    """A SQL string expression for text with newlines."""
    return " || chr(10) || ".join(P.q(x) for x in t.split("\n"))


CL = f"coalesce({CODE_LANG}, 'Unknown')"
PROMPTS = (f"prompts as (select repo, path, file_seq, {CL} as language, length(content) as content_length, "
           f"{_sqltext(_a)} || {CL} || {_sqltext(_b)} || path || {_sqltext(_c)} || lower({CL}) || {_sqltext(_d)} "
           f"|| content || {_sqltext(_e)} as prompt from relc r where exists "
           f"(select 1 from selected s where s.repo = r.repo and s.path = r.path))")
oracle("build_prompts", """select repo, path, file_seq, language, cast(length(prompt) as integer) as prompt_length,
  md5(prompt) as prompt_md5 from prompts""", (RELC,) + SEL + (PROMPTS,))
oracle("prompt_stats", """
select repo, path, file_seq, cast(content_length as integer) as content_length, cast(length(prompt) as integer) as prompt_length,
  cast(len(string_split(prompt, chr(10))) as integer) as prompt_lines from prompts""", (RELC,) + SEL + (PROMPTS,))
oracle("prompt_averages", "select repo, count(*) as prompts, avg(length(prompt)) as avg_prompt_length from prompts group by repo",
       (RELC,) + SEL + (PROMPTS,))


def _cut(x: str, keep: int, limit: int | None = None) -> str:
    limit = keep if limit is None else limit
    return f"(case when length({x}) > {limit} then substr({x}, 1, {keep}) || '...' else {x} end)"


_REPLY_FIELDS = ["summary", "main_functionality", "complexity_assessment", *rules.LIST_FIELDS]


def _last(key: str) -> str:
    """The last value of a key of the object ``value`` as text."""
    return (f"json_extract_string(list_filter(list_zip(json_keys(value), json_extract(value, '$.*')), lambda x: x[1] = '{key}')[-1][2], '$')")


EXP = (
    RESPONSES,
    "exp0 as (select *, regexp_extract(coalesce(response, ''), '(?s)(\\{.*\\})', 1) as blk from responses)",
    "exp1 as (select *, case when error is not null then 'failed' when blk <> '' and json_valid(blk) then 'parsed' "
    "else 'fallback' end as status from exp0)",
    # of a repeated key the last value counts
    "exp2 as (select *, case when status = 'parsed' then list_zip(json_keys(blk), json_extract(blk, '$.*')) end as kv from exp1)",
    "exp3 as (select *, " + ", ".join(f"list_filter(kv, lambda x: x[1] = '{f}')[-1][2] as j_{f}" for f in _REPLY_FIELDS) + " from exp2)",
    "exp as (select repo, path, file_seq, " + CL + " as language, status, " + ", ".join(f"j_{f}" for f in rules.LIST_FIELDS) + ", "
    "case status when 'failed' then " + P.q(rules.FAILED_EXPLANATION["summary"])
    + " when 'parsed' then coalesce(json_extract_string(j_summary, '$'), " + P.q(rules.EXPLANATION_DEFAULTS["summary"])
    + ") else " + ("coalesce(" + _strip("list_filter(string_split(coalesce(response, ''), chr(10)), lambda l: "
                       + _strip("l") + " <> '' and not starts_with(l, '{'))[1]") + ", 'Analysis provided')")
    + " end as summary, "
    "case status when 'failed' then " + P.q(rules.FAILED_EXPLANATION["main_functionality"])
    + " when 'parsed' then coalesce(json_extract_string(j_main_functionality, '$'), "
    + P.q(rules.EXPLANATION_DEFAULTS["main_functionality"]) + ") else coalesce(response, '')"
    + " end as main_functionality, "
    "case status when 'parsed' then coalesce(json_extract_string(j_complexity_assessment, '$'), 'Unknown') "
    "else 'Unknown' end as complexity_assessment from exp3)",
    "items as (select repo, path, file_seq, language, field, cast(s.i - 1 as integer) as pos, "
    "case when json_type(s.x) = 'VARCHAR' then json_extract_string(s.x, '$') else cast(s.x as varchar) end as value, "
    "json_type(s.x) = 'VARCHAR' as is_string from (select repo, path, file_seq, language, f.field, "
    "unnest(list_transform(cast(f.list as json[]), lambda x, i: {'x': x, 'i': i})) as s from ("
    + " union all ".join(f"select repo, path, file_seq, language, '{f}' as field, j_{f} as list from exp" for f in rules.LIST_FIELDS)
    + ") f where json_type(f.list) = 'ARRAY') u)",
)
oracle("parse_responses", "select repo, path, file_seq, language, status, summary, main_functionality, "
       + "case when status = 'fallback' then " + _cut("summary", 200) + " else summary end as summary_short, "
       + "case when status = 'fallback' then " + _cut("main_functionality", 500)
       + " else main_functionality end as functionality_short, complexity_assessment, "
       + ", ".join(f"cast(coalesce(json_array_length(j_{f}), 0) as integer) as n_{f}"
                   for f in rules.LIST_FIELDS) + " from exp", EXP)
oracle("explanation_items", "select repo, path, file_seq, language, field, pos, value, is_string from items", EXP)

oracle("distinct_values", "select repo, field, cast(count(distinct value) as bigint) as n from items where is_string group by repo, field", EXP)

CPX = ("cpx as (select repo, split_part(complexity_assessment, ' ', 1) as complexity, count(*) as files, "
       "min(file_seq) as first_seq from exp where complexity_assessment is not null and complexity_assessment <> '' group by 1, 2)")
oracle("complexity_distribution", "select repo, complexity, files from cpx", EXP + (CPX,))


def _ranked(field: str, label: str, n: int, alias: str = "occurrences") -> str:
    return (f"select repo, rank, {label}, occurrences as {alias} from (select repo, value as {label}, occurrences, "
            f"cast(row_number() over (partition by repo order by occurrences desc, f1, f2) as integer) as rank from "
            f"(select repo, value, count(*) as occurrences, arg_min(file_seq, (file_seq, pos)) as f1, "
            f"arg_min(pos, (file_seq, pos)) as f2 from items where field = '{field}' and is_string group by 1, 2) a) b "
            f"where rank <= {n}")


CP = f"cp as ({_ranked('code_patterns', 'pattern', rules.COMMON_PATTERNS_N)})"
KT = f"kt as ({_ranked('dependencies', 'technology', rules.KEY_TECHNOLOGIES_N)})"
_th_union = " union all ".join(
    f"select repo, file_seq, pos, {i} as idx, {P.q(t)} as theme from items where field = 'improvement_suggestions' "
    f"and is_string and {P.contains_any('lower(value)', ws)}" for i, (t, ws) in enumerate(rules.IMPROVEMENT_THEMES))
TH = (f"th as (select repo, cast(row_number() over (partition by repo order by f1, f2, f3) as integer) as rank, theme, suggestions "
      f"from (select repo, theme, count(*) as suggestions, arg_min(file_seq, (file_seq, pos, idx)) as f1, "
      f"arg_min(pos, (file_seq, pos, idx)) as f2, arg_min(idx, (file_seq, pos, idx)) as f3 from ({_th_union}) h group by 1, 2) x)")
oracle("common_patterns", "select * from cp", EXP + (CP,))
oracle("key_technologies", "select * from kt", EXP + (KT,))
oracle("top_values", "select repo, rank, pattern as value, occurrences, 'code_patterns' as field from cp union all "
       "select repo, rank, technology, occurrences, 'dependencies' from kt", EXP + (CP, KT))
oracle("improvement_themes", "select * from th", EXP + (TH,))

INS = ("ins as (select repo, 'files' as section, cast(0 as bigint) as pos, cast(null as varchar) as value, count(*) as n "
       "from exp group by repo "
       "union all select repo, 'complexity', first_seq, complexity, files from cpx "
       "union all select repo, 'pattern', rank, pattern, occurrences from cp "
       "union all select repo, 'technology', rank, technology, occurrences from kt "
       "union all select repo, 'theme', rank, theme, suggestions from th)")
oracle("insights_summary", "select * from ins", EXP + (CPX, CP, KT, TH, INS))

_cat_case = "(case " + " ".join(f"when {P.contains_any('lower(value)', ws)} then {P.q(c)}"
                                for c, ws in rules.IMPROVEMENT_CATEGORIES) + f" else {P.q(rules.IMPROVEMENT_OTHER)} end)"
oracle("improvement_categories", f"""
select repo, {_cat_case} as category, count(*) as suggestions from items
where field = 'improvement_suggestions' and is_string group by 1, 2""", EXP)

oracle("complexity_groups", f"select repo, complexity_assessment as complexity, file_seq, path, language, "
       f"summary, {_cut('summary', 100)} as summary_short from exp", EXP)

oracle("size_by_complexity", f"""
select e.repo, case when e.complexity_assessment is not null and e.complexity_assessment <> ''
  then split_part(e.complexity_assessment, ' ', 1) else 'Unknown' end as complexity,
  avg(coalesce(l.lines, 1)) as avg_lines, count(*) as files
from exp e left join (select repo, path, len(string_split(content, chr(10))) as lines from collected) l
  on e.repo = l.repo and e.path = l.path group by 1, 2""", EXP + (COLLECTED,))


def _first_files(field: str, label: str, expr: str, top: str) -> str:
    return (f"select repo, value as {label}, string_agg(lbl, '|' order by r) as first_files from "
            f"(select repo, value, {expr} as lbl, row_number() over (partition by repo, value order by file_seq, pos) as r "
            f"from items i where field = '{field}' and is_string and exists (select 1 from {top} t where t.repo = i.repo "
            f"and t.{label} = i.value)) a where r <= {rules.USAGE_FILES_SHOWN} group by 1, 2")


DU = f"du as ({_ranked('dependencies', 'dependency', rules.DEPENDENCY_USAGE_N, 'files')})"
oracle("dependency_usage", f"""
select d.repo, d.rank, d.dependency, d.files, f.first_files from du d
join ({_first_files('dependencies', 'dependency', 'path', 'du')}) f on d.repo = f.repo and d.dependency = f.dependency""",
       EXP + (DU,))

PU = f"pu as ({_ranked('code_patterns', 'pattern', rules.PATTERN_USAGE_N, 'files')})"
oracle("pattern_usage", f"""
select p.repo, p.rank, p.pattern, p.files, l.languages, l.language_list, f.first_files from pu p
join (select repo, value as pattern, count(distinct language) as languages,
        string_agg(distinct language, ', ' order by language) as language_list
      from items i where field = 'code_patterns' and is_string
        and exists (select 1 from pu t where t.repo = i.repo and t.pattern = i.value) group by 1, 2) l
  on p.repo = l.repo and p.pattern = l.pattern
join ({_first_files('code_patterns', 'pattern', "path || ' (' || language || ')'", 'pu')}) f
  on p.repo = f.repo and p.pattern = f.pattern""", EXP + (PU,))

CP5 = f"cp5 as ({_ranked('code_patterns', 'pattern', 5)})"
KT5 = f"kt5 as ({_ranked('dependencies', 'technology', 5)})"
OV = ("ov as (select b.repo, b.files, b.n_languages, b.languages, coalesce(d.up, 0) as unique_patterns, "
      "coalesce(d.ud, 0) as unique_dependencies, coalesce(d.pu, 0) / b.files as patterns_per_file, coalesce(p.s, '') as top_patterns, coalesce(k.s, '') as top_dependencies "
      "from (select repo, count(*) as files, count(distinct language) as n_languages, "
      "string_agg(distinct language, ', ' order by language) as languages from exp group by repo) b "
      "left join (select repo, count(distinct case when field = 'code_patterns' then value end) as up, "
      "count(distinct case when field = 'dependencies' then value end) as ud, "
      "count(*) filter (where field = 'code_patterns') as pu from items where is_string group by repo) d on b.repo = d.repo "
      "left join (select repo, string_agg(pattern, '|' order by rank) as s from cp5 group by repo) p on b.repo = p.repo "
      "left join (select repo, string_agg(technology, '|' order by rank) as s from kt5 group by repo) k on b.repo = k.repo)")
oracle("explanation_overview", "select * from ov", EXP + (CP5, KT5, OV))


def _list_sql(field: str, k: int) -> str:
    own = f"from items i where i.repo = e.repo and i.path = e.path and i.field = '{field}'"
    return (f"coalesce((select string_agg(value, '|' order by pos) {own}), '') as {field}, "
            f"cast(greatest(coalesce((select count(*) {own}), 0) - {k}, 0) as integer) as {field}_more")


oracle("explanation_details", "select repo, path, file_seq, language, summary, complexity_assessment, "
       "main_functionality as functionality, " + _cut("main_functionality", 197, 200) + " as functionality_short, "
       + ", ".join(_list_sql(f, k) for f, k in [("key_components", 5), ("dependencies", 5), ("code_patterns", 3),
                                                ("improvement_suggestions", 3)]) + " from exp e", EXP)

oracle("code_analysis_overview", """
select * from ins where section not in ('pattern', 'technology') or (section = 'pattern' and pos <= 5)
  or (section = 'technology' and pos <= 8)""", EXP + (CPX, CP, KT, TH, INS))

_cat_names = [c for c, _ in rules.IMPROVEMENT_CATEGORIES] + [rules.IMPROVEMENT_OTHER]
_cat_cols = {c: "suggestions_" + c.lower().replace(" ", "_") for c in _cat_names}
oracle("run_summary", f"""
select r.repo, r.files_retrieved, coalesce(s.n, 0) as files_selected, coalesce(o.files, 0) as files_analyzed,
  coalesce(o.n_languages, 0) as languages_used, coalesce(o.unique_patterns, 0) as unique_patterns,
  coalesce(o.unique_dependencies, 0) as unique_dependencies, p.a as avg_prompt_length, coalesce(g.n, 0) as suggestions,
  {', '.join(f'coalesce(g.{a}, 0) as {a}' for a in _cat_cols.values())}
from (select repo, count(*) as files_retrieved from collected group by repo) r
left join (select repo, count(*) as n from selected group by repo) s on r.repo = s.repo
left join ov o on r.repo = o.repo
left join (select repo, avg(length(prompt)) as a from prompts group by repo) p on r.repo = p.repo
left join (select repo, count(*) as n, {', '.join(f"count(*) filter (where is_string and c = {P.q(c)}) as {a}" for c, a in _cat_cols.items())}
  from (select *, {_cat_case} as c from items where field = 'improvement_suggestions') x group by repo) g on r.repo = g.repo""",
       EXP + (COLLECTED, CP5, KT5, OV, RELC) + SEL + (PROMPTS,))

oracle("analysis_success", "select repo, path, file_seq, status <> 'failed' as success, "
       + ", ".join(f"cast(coalesce(json_array_length(j_{f}), 0) as integer) as {f}_count"
                   for f in rules.LIST_FIELDS) + ", complexity_assessment from exp", EXP)
oracle("success_ratio", "select repo, count(*) as files, "
       "count(*) filter (where status <> 'failed') / count(*) * 100 as success_pct from exp group by repo", EXP)

OPEN = ("open_issues as (select distinct d.source as repo, t.title from documents d, "
        "(values ('Add unit tests'), ('investigate: testing')) t(title))")
_txt = ("case when is_string then " + _strip("value") + " else coalesce(nullif(" + _last("text") + ", ''), nullif(" + _last("description") + ", ''), value) end")
def _issues(opened: bool) -> str:
    check = ("where not exists (select 1 from open_issues o where o.repo = f.repo "
             "and lower(o.title) in (lower(f.title), lower(f.title_short)))") if opened else ""
    return f"""
select repo, src, o1, o2, title, title_short, {P.q(rules.ISSUE_BODY_HEAD)} || title || {_sqltext(rules.ISSUE_BODY_TAIL)} || repo || '/'
  || {P.q(rules.ISSUE_REPORT_NAME)} || chr(10) as body, {P.q('|'.join(rules.ISSUE_LABELS))} as labels
from (select * exclude (text), text as title, case when length(text) <= {rules.ISSUE_TITLE_MAX} then text
        else substr(text, 1, {rules.ISSUE_TITLE_CUT}) || '...' end as title_short
      from (select repo, arg_min(src, (src, o1, o2)) as src, arg_min(o1, (src, o1, o2)) as o1,
              arg_min(o2, (src, o1, o2)) as o2, arg_min(text, (src, o1, o2)) as text
            from (select *, lower(text) as k from (
                    select repo, 0 as src, cast(rank as bigint) as o1, 0 as o2, {_strip("'Investigate: ' || theme")} as text from th
                    union all
                    select repo, 1, file_seq, pos, {_strip(_txt)} from items where field = 'improvement_suggestions') c) d
            where k <> '' group by repo, k) e) f
{check}"""


oracle("issue_candidates", _issues(True), EXP + (TH, OPEN))
oracle("issue_candidates_ado", _issues(False), EXP + (TH,))

# ---------------------------------------------------------------- §2.9
from codecensus import report_text as T  # noqa: E402


def _fmt1(x: str) -> str:
    return f"printf('%.1f', cast({x} as double))"


def _size_sql(b: str) -> str:
    d = f"cast({b} as double)"
    return (f"(case when {b} = 0 then '0 B' when {d} < 1024 then {_fmt1(d)} || ' B' "
            f"when {d} < 1048576 then {_fmt1(d + ' / 1024')} || ' KB' "
            f"when {d} < 1073741824 then {_fmt1(d + ' / 1048576')} || ' MB' "
            f"else {_fmt1(d + ' / 1073741824')} || ' GB' end)")


TOT = "tot as (select repo, count(*) as total_files, cast(sum(coalesce(size, 0)) as bigint) as total_size from rel group by repo)"
oracle("format_size", f"select repo, total_size, {_size_sql('total_size')} as size_text from tot", (REL, TOT))

oracle("safe_percentage", f"""
select repo, test_files, total_files, {_pct('test_files', 'total_files')} as test_pct
from (select repo, count(*) filter (where {FLAGS['test']}) as test_files, count(*) as total_files from rel group by repo) t""",
       (REL,))

DQ = ("dq as (select repo, documentation_files, total_files, " + _pct('documentation_files', 'total_files') + " as ratio, "
      "case when documentation_files = 0 then 'Poor' when documentation_files < 3 then 'Basic' "
      "when documentation_files < 8 then 'Good' else 'Excellent' end as tier from "
      f"(select repo, count(*) filter (where {FLAGS['documentation']}) as documentation_files, count(*) as total_files "
      "from rel group by repo) t)")
oracle("documentation_quality", "select * from dq", (REL, DQ))

_dg = " union all ".join(
    f"select repo, {P.q(g)} as doc_group, file_seq, path from rel where {FLAGS['documentation']} and "
    f"{P.contains_any('lower(path)', ws)}" for g, ws in rules.DOC_GROUPS)
_none = " and ".join(f"not {P.contains_any('lower(path)', ws)}" for _, ws in rules.DOC_GROUPS)
DG = f"dg as ({_dg} union all select repo, 'Other', file_seq, path from rel where {FLAGS['documentation']} and {_none})"
oracle("documentation_groups", "select * from dg", (REL, DG))

_ci = f"({FLAGS['config']} and {P.contains_any('lower(path)', rules.CI_MARKERS)})"
WF = (f"wf0 as (select repo, file_seq, path, {_ci} as ci, {FLAGS['test']} as test, {FLAGS['build']} as build from rel)",
      "wf as (select c.repo, c.ci_files, c.test_files, " + _pct('c.test_files', 'c.total_files') + " as test_pct, c.build_files, "
      "coalesce(r.has_issues, false) as has_issues, coalesce(r.has_projects, false) as has_projects, "
      "coalesce(r.has_wiki, false) as has_wiki from "
      "(select repo, count(*) as total_files, count(*) filter (where ci) as ci_files, count(*) filter (where test) as test_files, "
      "count(*) filter (where build) as build_files from wf0 group by repo) c left join repos r on c.repo = r.repo)")
_facts = [("ci", "ci_files", "null"), ("test", "test_files", "test_pct"), ("build", "build_files", "null")] + [
    (f, f, "null") for f in ("has_issues", "has_projects", "has_wiki")]
oracle("development_workflow", " union all ".join(
    [f"select repo, '{part}' as part, cast(0 as bigint) as ord, cast(null as varchar) as path, cast({n} as bigint) as n, "
     f"cast({pct} as double) as pct, cast(null as boolean) as shown from wf" for part, n, pct in _facts]
    + [f"select repo, '{kind}_file', k, path, null, null, k <= {rules.BUILD_FILES_SHOWN} from (select *, row_number() over "
       f"(partition by repo order by file_seq) as k from wf0 where {kind}) x" for kind in ("ci", "build")]),
       (REL, PER_LANG, REPOS) + WF)

_R = rules.RECOMMENDATIONS
_ci2 = f"({FLAGS['config']} and (contains(path, '.github/workflows') or contains(lower(path), 'travis')))"
_dep2 = f"({FLAGS['config']} and {P.contains_any('lower(path)', rules.DEP_MANIFEST_MARKERS)})"
_sugg = ("case when is_string then value else coalesce(" + _last("text") + ", " + _last("description") + ", value) end")
_arch_n = " + ".join(f"(case when {c} then 1 else 0 end)" for c, _ in _arch_items())
RI = ("ri as (select s.repo, s.total_files, s.docs, s.tests, s.ci, s.dep_files, coalesce(m.large, 0) as large, "
      "coalesce(m.nested, 0) as nested, coalesce(a.n_arch, 0) as n_arch, ai.ai_test, ai.ai_error, ai.ai_perf from "
      f"(select repo, count(*) as total_files, count(*) filter (where {FLAGS['documentation']}) as docs, "
      f"count(*) filter (where {FLAGS['test']}) as tests, count(*) filter (where {_ci2}) as ci, "
      f"count(*) filter (where {_dep2}) as dep_files from rel group by repo) s "
      f"left join (select repo, count(*) filter (where lines > {rules.LARGE_FILE_LINES}) as large, "
      f"count(*) filter (where max_indentation > {rules.DEEP_NESTING_LEVEL}) as nested from fm group by repo) m on s.repo = m.repo "
      f"left join (select repo, {_arch_n} as n_arch from flags) a on s.repo = a.repo "
      "left join (select repo, "
      "arg_min(t, (file_seq, pos)) filter (where contains(lower(t), 'test')) as ai_test, "
      f"arg_min(t, (file_seq, pos)) filter (where {P.contains_any('lower(t)', rules.AI_ERROR_WORDS)}) as ai_error, "
      "arg_min(t, (file_seq, pos)) filter (where contains(lower(t), 'performance')) as ai_perf "
      f"from (select repo, file_seq, pos, {_sugg} as t from items where field = 'improvement_suggestions') x group by repo) ai "
      "on s.repo = ai.repo)")
_recs = ("list_filter([" + ", ".join([
    f"case when docs < 3 then {P.q(_R['docs'])} end",
    f"case when coalesce(cast(tests as double) / nullif(total_files, 0), 0) < {rules.TEST_RATIO_MIN} then {P.q(_R['tests'])} end",
    f"case when large > 0 then {P.q(_R['large'].split('{n}')[0])} || cast(large as varchar) || {P.q(_R['large'].split('{n}')[1])} end",
    f"case when nested > 0 then {P.q(_R['nesting'].split('{n}')[0])} || cast(nested as varchar) || {P.q(_R['nesting'].split('{n}')[1])} end",
    f"case when n_arch = 0 then {P.q(_R['architecture'])} end",
    f"case when ci = 0 then {P.q(_R['ci'])} end",
    f"case when dep_files = 0 then {P.q(_R['deps'])} end",
    f"case when ai_test is not null then {P.q(_R['ai_testing'])} || ai_test end",
    f"case when ai_error is not null then {P.q(_R['ai_error'])} || ai_error end",
    f"case when ai_perf is not null then {P.q(_R['ai_performance'])} || ai_perf end",
]) + "], lambda x: x is not null)")
REC = (f"rec as (select repo, cast(s.i as integer) as pos, s.x as text from (select repo, unnest(list_transform("
       f"case when len({_recs}) > 0 then {_recs} else [{P.q(_R['none'])}] end, lambda x, i: {{'x': x, 'i': i}})) as s "
       "from ri) u)")
oracle("recommendations", "select * from rec", (REL, RELC) + FM + (FLAGS_CTE,) + EXP + (RI, REC))

_tech_rows = []
for _cat, _group in rules.TECHNOLOGY_GROUPS:
    for _i, (_tech, _pats) in enumerate(_group.items()):
        _tech_rows.append(f"select repo, {P.q(_cat)} as section, {_i} as k, {P.q(_tech)} as item "
                          f"from flags where {_any_sql(_pats)}")
TOOLING = (f"tooling as (select repo, category, cast(row_number() over (partition by repo, category order by f, s, p, t) as integer) as rank, tool "
           f"from (select repo, category, tool, arg_min(file_seq, (file_seq, sr, pos, ti)) as f, arg_min(sr, (file_seq, sr, pos, ti)) as s, "
           f"arg_min(pos, (file_seq, sr, pos, ti)) as p, arg_min(ti, (file_seq, sr, pos, ti)) as t "
           f"from ({' union all '.join(_tool_rows)}) h group by 1, 2, 3) x)")
oracle("technology_stack", f"""
select repo, 'project_type' as section, cast(0 as bigint) as pos, {_project_type_sql()} as item from flags
union all
select repo, section, cast(row_number() over (partition by repo, section order by k) - 1 as bigint) as pos, item
from ({' union all '.join(_tech_rows)}) t
union all
select repo, 'package_managers', file_seq, {_mgr_case} from man where name not in ('package.json', 'composer.json') or json_valid(content)
union all
select repo, category, cast(rank as bigint), tool from tooling""", (RELC, FLAGS_CTE, MAN, DEPS, TOOLING))


def _thousands(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def _quick_doc(a, b):
    return a + b


def _tmpl_sql(template: str, **vals) -> str:
    import re as _re
    out, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(_sqltext(template[pos:m.start()]))
        out.append(f"coalesce(cast({vals[m.group(1)]} as varchar), 'None')")
        pos = m.end()
    if pos < len(template):
        out.append(_sqltext(template[pos:]))
    return "(" + " || ".join(out) + ")"


def _quick_sql(src: str, repos_cte: str, flags: dict[str, str] = FLAGS, lang: str = LANG) -> str:
    ll = _tmpl_sql(T.QUICK_LANGUAGE_LINE, language="language", files="files")
    return f"""
select t.repo, coalesce(r.repo, {P.q(T.QUICK_DEFAULT_NAME)}) as name,
  coalesce(r.description, {P.q(T.QUICK_DEFAULT_DESCRIPTION)}) as description,
  coalesce(r.language, {P.q(T.QUICK_DEFAULT_LANGUAGE)}) as language, t.total_files,
  coalesce(l.top_languages, '') as top_languages, {_size_sql('t.total_size')} as size_text,
  t.documentation_files, t.test_files, t.config_files,
  {_tmpl_sql(T.QUICK, name=f"coalesce(r.repo, {P.q(T.QUICK_DEFAULT_NAME)})",
             description=f"coalesce(r.description, {P.q(T.QUICK_DEFAULT_DESCRIPTION)})",
             language=f"coalesce(r.language, {P.q(T.QUICK_DEFAULT_LANGUAGE)})", total_files=_thousands('t.total_files'))}
  || coalesce(l.lines, '') ||
  {_tmpl_sql(T.QUICK_STATS, size=_size_sql('t.total_size'), docs='t.documentation_files', tests='t.test_files',
             configs='t.config_files')} as document
from (select repo, count(*) as total_files, cast(sum(coalesce(size, 0)) as bigint) as total_size,
        count(*) filter (where {flags['documentation']}) as documentation_files,
        count(*) filter (where {flags['test']}) as test_files, count(*) filter (where {flags['config']}) as config_files
      from {src} group by repo) t
left join {repos_cte} r on t.repo = r.repo
left join (select repo, string_agg(language || ':' || cast(files as varchar), '|' order by k) as top_languages,
             string_agg({ll}, '' order by k) as lines
           from (select *, row_number() over (partition by repo order by files desc, first_seq) as k
                 from (select repo, {lang} as language, count(*) as files, min(file_seq) as first_seq from {src}
                       where {lang} is not null group by 1, 2) a) b
           where k <= {rules.TOP_QUICK_LANGUAGES} group by repo) l on t.repo = l.repo"""


oracle("quick_summary", _quick_sql("rel", "repos"), (REL, PER_LANG, REPOS))
oracle("analyze_quick", f"select repo, document from ({_quick_sql('rel', 'repos')}) q", (REL, PER_LANG, REPOS))

_guide_flags = ("select repo, bool_or(contains(lower(path), 'dockerfile')) as docker, "
                "bool_or(ends_with(lower(path), 'package.json')) as npm, "
                "bool_or(ends_with(lower(path), 'requirements.txt')) as python, "
                "bool_or(ends_with(lower(path), 'makefile') or path = 'Makefile') as make from collected group by repo")
_guide_names = "concat_ws('|', " + ", ".join(f"case when {k} then {P.q(k)} end" for k, _, _ in T.GUIDE_SECTIONS) + ")"
_guide_text = ("concat_ws(chr(10), " + _tmpl_sql(T.GUIDE_HEADER, repo="repo") + ", "
               + ", ".join(f"case when {k} then {_sqltext(h + chr(10) + b)} end" for k, h, b in T.GUIDE_SECTIONS) + ")")
GUIDE = f"guide as (select repo, {_guide_names} as sections, {_guide_text} as guide from ({_guide_flags}) g)"
oracle("build_run_guide", "select * from guide", (COLLECTED, GUIDE))

CLONE_LIST = "clist as (select repo, file_seq, path, 'file' as type, cast(length(content) as bigint) as size from collected)"
oracle("analyze_clone", f"""
select repo, 'functional' as doc, document as text from ({_quick_sql('clist', 'repos', BFLAGS, CODE_LANG)}) q
union all select repo, 'build_and_run', guide from guide""", (COLLECTED, GUIDE, CLONE_LIST, PER_LANG, REPOS))

# the clone flow explains every collected file that has a reply
CEXP = (EXP[0], EXP[1].replace("from responses", "from responses r where exists "
                               "(select 1 from collected c where c.repo = r.repo and c.path = r.path)")) + EXP[2:]
_structure = " union all ".join(
    f"select repo, 'structure' as section, cast({i} as bigint) as pos, '{label}' as value, cast({x} as bigint) as n from collected group by repo"
    for i, (label, x) in enumerate([("files", "count(*)"), ("characters", "sum(length(content))")]
                                   + [(c, f"count(*) filter (where {BFLAGS[c]})") for c in rules.CATEGORIES]))
_managers = " union all ".join(
    f"select repo, {i} as k, {P.q(m)} as manager from collected group by repo having bool_or(ends_with(lower(path), {P.q(sfx)}))"
    for i, (m, sfx) in enumerate(rules.BASIC_MANAGERS))
oracle("clone_technical", f"""
{_structure}
union all select repo, 'language', 0, {CODE_LANG}, count(*) from collected where {CODE_LANG} is not null group by repo, {CODE_LANG}
union all select * from (select repo, 'largest', row_number() over (partition by repo order by length(content) desc, file_seq) as r,
    path, length(content) from collected) x where r <= {rules.TOP_LARGEST}
union all select repo, 'manager', row_number() over (partition by repo order by k) - 1, manager, 1 from ({_managers}) m
union all select repo, 'lines', 0, language, cast(sum(len(ls)) as bigint) from b3 group by repo, language
union all select repo, 'insight:' || section, pos, value, n from ins""",
       (COLLECTED,) + CEXP + tuple(x for x in BASIC if x != COLLECTED) + (CPX, CP, KT, TH, INS))
oracle("clone_insights", "select * from ins", (COLLECTED,) + CEXP + (CPX, CP, KT, TH, INS))
oracle("write_results_json", "select * from ins", (COLLECTED,) + CEXP + (CPX, CP, KT, TH, INS))
oracle("clone_issues", _issues(True), (COLLECTED,) + CEXP + (TH, OPEN))
oracle("write_reports", f"""
select repo, 'report' as doc, cast(len(string_split(document, chr(10))) as bigint) as lines,
  cast(length(replace(document, chr(10), '')) as bigint) as chars from ({_quick_sql('rel', 'repos')}) q""", (REL, PER_LANG, REPOS))

# ---------------------------------------------------------------- §2.4 single parsers, ADO issues, HTML
for _fn, _mgr in [("deps_npm", "npm"), ("deps_pip", "pip"), ("deps_pipenv", "pipenv"), ("deps_poetry", "poetry"),
                  ("deps_go", "go"), ("deps_maven", "maven"), ("deps_bundler", "bundler"),
                  ("deps_composer", "composer")]:
    oracle(_fn, f"select * from deps where manager = '{_mgr}'", DEP_CTES)
oracle("deps_cargo", f"select repo, path, file_seq, {_mgr_case} as manager from man where name = 'Cargo.toml'",
       (RELC, MAN))

PAGES = ("pages_files as (select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as repo, "
         "(case when regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) = '' then 'index' "
         "else regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) end) || '.html' as path, "
         "page_id as file_seq, html as content from pages)")
_fm_html = tuple(x.replace("from relc", "from pages_files") for x in FM)
oracle("file_metrics_html", "select * from fm", (PAGES,) + _fm_html)

from codecensus.plans import oracle_reports, oracle_upkeep  # noqa: E402, F401
