"""Oracle SQL of the whole reports: every fragment of every section is put
together from the parts' own statements."""

from __future__ import annotations

from codecensus import report_text as T
from codecensus import rules
from codecensus.plans import oracle as O
from codecensus.plans import sqlparts as P

LAST = 1 << 62
SEPARATOR_PART = 1 << 30
DATE = "2026-01-01 00:00:00"

fill, text_sql, thousands, fmt1 = O._tmpl_sql, O._sqltext, O._thousands, O._fmt1


def nonempty(text: str, head: str, tail: str = "") -> str:
    after = f" || {text_sql(tail)}" if tail else ""
    return f"(case when coalesce({text}, '') <> '' then {text_sql(head)} || {text}{after} else '' end)"


def one(source: str, text: str, part: int = 0, where: str = "") -> str:
    return f"select repo, {part} as part, 0 as ord, {text} as text from {source}" + (f" where {where}" if where else "")


def listed(source: str, part: int, head: str, line: str, order: str = "file_seq", tail: str = "\n") -> str:
    """Head, a row for each row of ``source``, and tail."""
    parts = [f"select repo, {part} as part, {order} as ord, {line} as text from {source} x"]
    for at, text in ((-1, head), (LAST, tail)):
        if text:
            parts.append(f"select distinct repo, {part}, {at}, {text_sql(text)} from {source} x")
    return " union all ".join(parts)


def joined(source: str, line: str, order: str, by: str = "repo") -> str:
    return f"(select {by}, string_agg({line}, '' order by {order}) as s from {source} x group by {by})"


# ---------------------------------------------------------------- sections: each selects repo, part, ord, text
SEP = text_sql(T.SECTION_SEPARATOR)
OVW = ("ovw as (select repo, repo as name, description, url, coalesce(language, 'Not specified') as language, stars, forks, "
       "size as size_kb, created, updated, topics, license from repos)")
PTC = f"ptc as (select repo, {O._project_type_sql()} as project_type, {O._api_sql()} as api_type from flags)"

HEADER = one("ovw", fill(T.HEADER, name="name", description="description", url="url", analysis_date=P.q(DATE), language="language"))

_bytes = f"""(select repo, language, row_number() over (partition by repo order by bytes desc, language) as rank,
  bytes / sum(bytes) over (partition by repo) * 100 as pct from per_lang qualify rank <= {rules.TOP_LANGUAGE_BYTES})"""
_pt = "coalesce(p.project_type, 'Unknown')"
OVERVIEW = "select o.repo, 0 as part, 0 as ord, " + fill(
    T.OVERVIEW, stars=thousands("o.stars"), forks=thousands("o.forks"), size=thousands("o.size_kb"), created="o.created",
    updated="o.updated", project_type=_pt, project_type_lower=f"lower({_pt})") + " || " + nonempty(
    "l.s", T.OVERVIEW_LANGUAGES_HEAD, "\n") + f" || (case when o.topics <> '' then {fill(T.OVERVIEW_TOPICS, topics='o.topics')} else '' end)" \
    f" || (case when coalesce(o.license, '') <> '' then {fill(T.OVERVIEW_LICENSE, license='o.license')} else '' end) as text " \
    "from ovw o left join ptc p on o.repo = p.repo left join " + joined(
        _bytes, fill(T.OVERVIEW_LANGUAGE_LINE, language="language", pct=fmt1("pct")), "rank") + " l on o.repo = l.repo"

LDIST = f"""ldist as (select repo, language, files, first_seq, files / sum(files) over (partition by repo) * 100 as pct
  from (select repo, {O.LANG} as language, count(*) as files, min(file_seq) as first_seq from rel
        where {O.LANG} is not null group by 1, 2) x)"""
_bar_len = "cast(floor(20 * pct / 100) as integer)"
_bar = (f"'`' || repeat({P.q(T.PROGRESS_FULL)}, {_bar_len}) || repeat({P.q(T.PROGRESS_EMPTY)}, {rules.PROGRESS_WIDTH} - {_bar_len}) || '`'")
_dirs = f"""(select repo, case when directory = 'root' then {P.q(T.ROOT_DIRECTORY_LABEL)} else directory end as directory, files,
  row_number() over (partition by repo order by files desc, first_seq) as rank from (select repo, {P.directory('path')} as directory,
  count(*) as files, min(file_seq) as first_seq from rel group by 1, 2) a qualify rank <= {rules.TOP_DIRECTORIES})"""
_cats = "(" + " union all ".join(
    f"select repo, {i} as k, {P.q(T.CATEGORY_LABELS[c])} as label, count(*) as files from rel where {O.FLAGS[c]} group by repo"
    for i, c in enumerate(rules.CATEGORIES)) + ")"
_big = f"""(select repo, path, coalesce(size, 0) as size, row_number() over (partition by repo order by coalesce(size, 0) desc, file_seq) as rank
  from rel qualify rank <= {min(rules.LARGEST_SHOWN, rules.TOP_LARGEST)})"""
STRUCTURE = ("select t.repo, 0 as part, 0 as ord, "
             + fill(T.STRUCTURE, total_files=thousands("t.total_files"), total_size=O._size_sql("t.total_size"))
             + f" || coalesce(l.s, '') || {text_sql(T.STRUCTURE_DIRECTORIES)} || {nonempty('d.s', T.DIRECTORY_TABLE_HEAD)}"
             + f" || {text_sql(T.STRUCTURE_CATEGORIES)} || coalesce(c.s, '') || {nonempty('b.s', T.LARGEST_HEAD)} as text from tot t"
             + " left join " + joined("ldist", fill(T.STRUCTURE_LANGUAGE_LINE, language="language", files="files", pct=fmt1("pct"), bar=_bar),
                                      "files desc, first_seq") + " l on t.repo = l.repo"
             + " left join " + joined(_dirs, fill(T.DIRECTORY_ROW, directory="directory", files="files"), "rank") + " d on t.repo = d.repo"
             + " left join " + joined(_cats, fill(T.CATEGORY_LINE, label="label", files="files"), "k") + " c on t.repo = c.repo"
             + " left join " + joined(_big, fill(T.LARGEST_ROW, path="path", size=O._size_sql("size")), "rank") + " b on t.repo = b.repo")

STACK = ("stack as (select repo, section, string_agg('- ' || item || chr(10), '' order by k) as s from ("
         + " union all ".join(O._tech_rows) + " union all select repo, category, rank, tool from tooling) t group by 1, 2)")


def _stack(section: str) -> str:
    return f"coalesce((select s from stack k where k.repo = p.repo and k.section = '{section}'), '')"


_tools = " || ".join(nonempty(_stack(k), head, "\n") for k, head in T.TOOL_GROUP_LABELS)
_tech = " || ".join([fill(T.TECH_STACK, project_type="p.project_type")] + [
    nonempty(_stack(c), f"### {T.TECH_CATEGORY_LABELS[c]}\n\n", "\n") for c in T.TECH_CATEGORY_ORDER])
_managers = f"(select repo, file_seq, {O._mgr_case} as manager from man where name not in ('package.json', 'composer.json') or json_valid(content))"
TECH_STACK = " union all ".join([one("ptc p", _tech), listed(_managers, 1, T.PACKAGE_MANAGERS_HEAD, "'- ' || manager || chr(10)"),
                                 one("(select repo, " + _tools + " as s from ptc p) q", nonempty("s", T.DEV_TOOLS_HEAD), 2)])

_cap = f"(case when scope = 'prod' then {rules.PROD_DEPS_SHOWN} else {rules.DEV_DEPS_SHOWN} end)"
MGR = f"""mgr as (select repo, scope, manager, n, f1, f2, {fill(T.MANAGER_LINE, manager="upper(left(manager, 1)) || substr(manager, 2)", n="n")}
  || s || (case when n > {_cap} then {fill(T.MORE_LINE, n=f"n - {_cap}")} else '' end) || chr(10) as line
  from (select repo, scope, manager, count(*) as n, arg_min(file_seq, (file_seq, pos)) as f1, arg_min(pos, (file_seq, pos)) as f2,
          string_agg({fill(T.DEPENDENCY_LINE, package="package")}, '' order by r) filter (where r <= {_cap}) as s
        from (select *, row_number() over (partition by repo, scope, manager order by file_seq, pos) as r from deps) d group by 1, 2, 3) m)"""


def _deps(scope: str) -> str:
    return joined(f"(select * from mgr where scope = '{scope}')", "line", "f1, f2")


DEPENDENCIES = ("select b.repo, 0 as part, 0 as ord, " + fill(T.DEPENDENCIES, total="coalesce(n.total, 0)")
                + f" || (case when coalesce(n.total, 0) > 0 then {text_sql(T.PROD_HEAD)} || coalesce(p.s, '') else '' end)"
                + f" || (case when coalesce(n.n_dev, 0) > 0 then {text_sql(T.DEV_HEAD)} || coalesce(d.s, '') else '' end) as text from repos b"
                + " left join (select repo, count(*) as total, count(*) filter (where scope = 'dev') as n_dev from deps group by repo) n on b.repo = n.repo"
                + f" left join {_deps('prod')} p on b.repo = p.repo left join {_deps('dev')} d on b.repo = d.repo")

FMS = f"""fms as (select b.repo, {', '.join(f'coalesce(f.{c}, 0) as {c}' for c in ('total_lines', 'code_lines', 'comment_lines', 'blank_lines', 'files_analyzed', 'n_big', 'n_deep'))}
  from repos b left join (select repo, sum(lines)::bigint as total_lines, sum(code_lines)::bigint as code_lines, sum(comment_lines)::bigint as comment_lines,
    sum(blank_lines)::bigint as blank_lines, count(*) as files_analyzed, count(*) filter (where lines > {rules.LARGE_FILE_LINES}) as n_big,
    count(*) filter (where max_indentation > {rules.DEEP_NESTING_LEVEL}) as n_deep from fm group by repo) f on b.repo = f.repo)"""
_by_lang = """(select f.repo, f.language, count(*) as files, sum(f.lines)::bigint as lines, sum(f.code_lines)::bigint as code, sum(f.comment_lines)::bigint as comments,
  min(l.first_seq) as first_seq from fm f join ldist l on f.repo = l.repo and f.language = l.language group by 1, 2)"""
_metrics = (fill(T.METRICS, total_lines=thousands("total_lines"), code_lines=thousands("code_lines"),
                 code_pct=fmt1(O._pct("code_lines", "total_lines")), comment_lines=thousands("comment_lines"),
                 comment_pct=fmt1(O._pct("comment_lines", "total_lines")), blank_lines=thousands("blank_lines"),
                 blank_pct=fmt1(O._pct("blank_lines", "total_lines")), files_analyzed=thousands("files_analyzed"))
            + " || " + nonempty("r.s", T.METRICS_TABLE_HEAD) + f" || (case when n_big + n_deep > 0 then {text_sql(T.COMPLEXITY_HEAD)} else '' end)")
_rows = joined(_by_lang, fill(T.METRICS_ROW, language="language", files="files", lines=thousands("lines"), code=thousands("code"),
                              comments=thousands("comments")), "lines desc, first_seq")
METRICS = " union all ".join([
    f"select f.repo, 0 as part, 0 as ord, {_metrics} as text from fms f left join {_rows} r on f.repo = r.repo",
    one("fms", fill(T.LARGE_FILES_HEAD, n="n_big"), 1, "n_big > 0"),
    listed(f"(select * from fm where lines > {rules.LARGE_FILE_LINES})", 2, "", fill(T.LARGE_FILE_LINE, path="path", lines="lines")),
    one("fms", fill(T.NESTED_HEAD, n="n_deep"), 3, "n_deep > 0"),
    listed(f"(select * from fm where max_indentation > {rules.DEEP_NESTING_LEVEL})", 4, "",
           fill(T.NESTED_LINE, path="path", depth="max_indentation"))])

_arch = joined(f"({O._ordered_union(O._arch_items())})", fill(T.ARCH_LINE, pattern="v"), "k")
ARCHITECTURE = (f"select p.repo, 0 as part, 0 as ord, {text_sql(T.ARCHITECTURE)} || {nonempty('a.s', T.ARCH_HEAD, chr(10))}"
                f" || (case when p.api_type is not null then {fill(T.API_BLOCK, api_type='p.api_type')} else '' end)"
                f" || (case when a.s is null and p.api_type is null then {text_sql(T.ARCH_NONE)} else '' end) as text "
                f"from ptc p left join {_arch} a on p.repo = a.repo")


def _file_list(field: str, head: str, line: str) -> str:
    before, after = line.split("{x}")
    items = (f"(select string_agg({text_sql(before)} || value || {text_sql(after)}, '' order by pos) from items i "
             f"where i.repo = e.repo and i.path = e.path and i.file_seq = e.file_seq and i.field = '{field}')")
    return nonempty(items, head, "\n")


_per_file = " || ".join([
    fill(T.CA_FILE, path="e.path", language="e.language", complexity="e.complexity_assessment", summary="e.summary"),
    "(case when coalesce(e.main_functionality, '') <> '' then " + fill(T.CA_FUNCTIONALITY, functionality="e.main_functionality") + " else '' end)",
    *[_file_list(*x) for x in T.CA_LIST_HEADS], text_sql(T.CA_FILE_END)])
_files = (f"(select e.repo, (o.importance::bigint << 40) + o.file_seq as place, {_per_file} as line from exp e "
          f"join (select repo, path, file_seq, {O._imp} as importance from exp) o on e.repo = o.repo and e.path = o.path)")


def _insight(section: str, most: int | None = None) -> str:
    return f"(select * from ins where section = '{section}'" + (f" and pos <= {most})" if most else ")")


CODE_ANALYSIS = " union all ".join([
    one(_insight("files"), f"{text_sql(T.CODE_ANALYSIS)} || {fill(T.CA_OVERVIEW, n='n')}"),
    listed(_insight("complexity"), 1, T.CA_COMPLEXITY_HEAD, fill(T.CA_COMPLEXITY_LINE, complexity="value", files="n"), "pos"),
    listed(_insight("pattern", T.CA_PATTERNS_SHOWN), 2, T.CA_PATTERNS_HEAD, "'- ' || value || chr(10)", "pos"),
    listed(_insight("technology", T.CA_TECH_SHOWN), 3, T.CA_TECH_HEAD, "'- ' || value || chr(10)", "pos"),
    listed(_files, 4, T.CA_DETAILS_HEAD, "line", "place", tail=""),
    listed(_insight("theme"), 5, T.CA_THEMES, fill(T.CA_THEME_LINE, theme="value"), "pos")])

_tier = "(case tier " + " ".join(f"when {P.q(t)} then {text_sql(x)}" for t, x in T.DOC_TIER_LINES.items()) + " end)"
_doc_line = fill(T.DOC_FILE_LINE, path="path")
_n_groups = len(rules.DOC_GROUPS)
DOCUMENTATION = " union all ".join(
    [one("dq", fill(T.DOCUMENTATION, n="documentation_files", pct=fmt1("ratio"))
         + f" || (case when documentation_files > 0 then {text_sql(T.DOC_AVAILABLE)} else '' end)")]
    + [listed(f"(select * from dg where doc_group = {P.q(g)})", 1 + i, T.DOC_GROUP_HEAD.replace("{label}", T.DOC_GROUP_LABELS[g]), _doc_line)
       for i, (g, _) in enumerate(rules.DOC_GROUPS)]
    + [listed("(select * from dg where doc_group = 'Other')", 1 + _n_groups, T.DOC_OTHER_HEAD, _doc_line),
       one("dq", f"{text_sql(T.DOC_QUALITY)} || {_tier}", 2 + _n_groups)])


def _enabled(flag: str) -> str:
    return f"(case when {flag} then {P.q(T.ENABLED)} else {P.q(T.DISABLED)} end)"


WORKFLOW = " union all ".join([
    one("wf", text_sql(T.WORKFLOW)), listed("(select * from wf0 where ci)", 1, T.CI_HEAD, _doc_line),
    one("wf", fill(T.TESTING, n="test_files", pct=fmt1("test_pct")), 2, "test_files > 0"),
    listed("(select * from wf0 where build)", 3, T.BUILD_HEAD, _doc_line),
    one("wf", fill(T.FEATURES, issues=_enabled("has_issues"), projects=_enabled("has_projects"), wiki=_enabled("has_wiki")), 4)])

_none = rules.RECOMMENDATIONS["none"]
RECOMMENDATIONS = (f"select repo, 0 as part, 0 as ord, {text_sql(T.RECOMMENDATIONS)} || (case when count(*) = 1 and min(text) = {P.q(_none)} "
                   f"then {text_sql(_none + chr(10) * 2)} else string_agg({fill(T.RECOMMENDATION_LINE, i='pos', text='text')}, '' order by pos) end)"
                   f" || {text_sql(T.BEST_PRACTICES)} as text from rec group by repo")
FOOTER = one("repos", fill(T.FOOTER, generated_on=P.q(DATE.replace(" ", " at ", 1))))

BEFORE = [(HEADER, False), (OVERVIEW, False), (STRUCTURE, False), (TECH_STACK, True), (DEPENDENCIES, False), (METRICS, True),
          (ARCHITECTURE, False)]
AFTER = [(DOCUMENTATION, True), (WORKFLOW, True), (RECOMMENDATIONS, False), (FOOTER, False)]
PARTS = (O.REL, O.RELC, *O.FM, O.FLAGS_CTE, O.MAN, O.DEPS, O.TOOLING, O.PER_LANG, O.REPOS, O.TOT, O.DQ, O.DG, *O.WF)
LAYOUT = (OVW, PTC, LDIST, STACK, MGR, FMS)


def report_sql(sections: list[tuple[str, bool]]) -> str:
    """All fragments. A section of several parts has its blank line in a row
    of its own, another one at its text's end."""
    out = []
    for i, (select, fragments) in enumerate(sections):
        last = i == len(sections) - 1
        end = "" if last or fragments else f" || {SEP}"
        out.append(f"select repo, {i} as section, part, ord, text{end} as text from ({select}) s{i}")
        if fragments and not last:
            out.append(f"select repo, {i}, {SEPARATOR_PART}, 0, {SEP} from ({select}) s{i} where part = 0 and ord <= 0")
    return ("select repo, cast(section as integer) as section, cast(part as integer) as part, cast(ord as bigint) as ord, text from ("
            + " union all ".join(out) + ") r where text <> ''")


NO_ITEMS = ("items as (select '' as repo, '' as path, 0::bigint as file_seq, '' as language, '' as field, 0 as pos, '' as value, "
            "true as is_string where false)")
O.oracle("render_report", report_sql(BEFORE + AFTER), (*PARTS, NO_ITEMS, O.RI, O.REC, *LAYOUT))

# the explained files: focus files and key files first, numbered by their place in the selection
FOCUS = ("focus as (select distinct repo, path, true as is_focus from (select repo, path from corpus where kind = 5 union all "
         "select repo, path from chosen where has_text union all select repo, path from extra where has_text) k)")
SELECTED = (*O.KF, FOCUS, *O.SEL[1:])
EXPLAINED = (O.EXP[0], O.EXP[1].replace(
    "from responses", "from (select r.repo, r.path, cast(s.rank as bigint) as file_seq, r.response, r.error from responses r "
                      "join selected s on r.repo = s.repo and r.path = s.path) r"), *O.EXP[2:])
FULL = (*PARTS, *SELECTED, *EXPLAINED, O.CPX, O.CP, O.KT, O.TH, O.INS, O.RI, O.REC, *LAYOUT)
O.oracle("analyze_full", report_sql([*BEFORE, (CODE_ANALYSIS, True), *AFTER]), FULL)
