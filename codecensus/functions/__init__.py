"""Column-expression helpers shared by the operators (no actions, no UDFs)."""

from codecensus.functions.paths import (  # noqa: F401
    name_of, suffix_of, directory_of, parts_of, parent_name_of, lower_name_of,
)
from codecensus.functions.text import (  # noqa: F401
    contains_any, ends_with_any, lines_of, is_blank, strip_py, format_size,
    safe_percentage, first_line, cut_with_ellipsis,
)
