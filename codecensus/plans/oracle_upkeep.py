"""Oracle SQL of the totals that upkeep keeps: counted over the whole later
snapshot."""

from __future__ import annotations

from codecensus import rules
from codecensus.operators.patterns import TERMS
from codecensus.plans import oracle as O
from codecensus.plans import sqlparts as P


def _count(measure: str, key: str, source: str, v: str = "0", where: str = "true") -> str:
    return (f"select repo, '{measure}' as measure, cast({key} as varchar) as key, count(*) as n, cast(sum({v}) as bigint) as v "
            f"from {source} where {where} group by repo, {key}")


_size = "coalesce(size, 0)"
_totals = [
    f"select repo, 'files' as measure, '' as key, count(*) as n, cast(sum({_size}) as bigint) as v from rel group by repo",
    _count("language", O.LANG, "rel", _size, f"{O.LANG} is not null"),
    _count("extension", f"coalesce(nullif({P.suffix('path')}, ''), 'no_extension')", "rel", _size),
    _count("directory", P.directory("path"), "rel", _size),
    _count("depth", "len(string_split(path, '/')) - 1", "rel", _size),
    *[f"select repo, 'category', '{c}', count(*), cast(sum({_size}) as bigint) from rel where {O.FLAGS[c]} group by repo" for c in rules.CATEGORIES],
    *[_count(m, "language", "fm", m) for m in ("lines", "blank_lines", "comment_lines", "code_lines")],
    *[f"select repo, 'term', {P.q(t)}, count(*), 0 from relc where contains(lower(coalesce(content, '')), {P.q(t)}) group by repo" for t in TERMS],
    _count("manager", O._mgr_case, "man", where="name not in ('package.json', 'composer.json') or json_valid(content)"),
    _count("package", "manager || ':' || scope", "deps"),
]
O.oracle("upkeep_totals", " union all ".join(_totals), (O.REL, O.RELC, *O.FM, O.MAN, O.DEPS))
O.SQL["upkeep_report"] = O.SQL["render_report"]
