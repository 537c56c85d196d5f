"""JSON texts judged as a strict parser judges them.

Spark's parsers read the first value of a text and stop there. ``one_value``
is the other half of the test: a text whose strings are replaced by ``s`` and
whose innermost brackets are closed again and again ends as one token if, and
only if, nothing follows the value that opened first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = {"allowSingleQuotes": "false"}
#: Column of a ``from_json`` schema that holds a malformed text.
BAD = "_bad"
STRICT = {**OPTIONS, "columnNameOfCorruptRecord": BAD}

_TOKEN = r"^(o|s|true|false|null|NaN|-?Infinity|-?[0-9][0-9.eE+-]*)$"


def bare(text: Column) -> Column:
    """The text with every string as ``s`` (a backslash elsewhere as ``e``)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", "e"), '"[^"]*"', "s")


def closed(structure: Column) -> Column:
    """A ``bare`` text with each pair of brackets, from the inside out, as
    ``o``. A step closes all pairs of a depth; there are at most as many
    steps as opening brackets."""
    opening = F.length(structure) - F.length(F.regexp_replace(structure, r"[\[{]", ""))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(opening, F.lit(1))), structure,
        lambda text, _: F.when(text.rlike(r"[\[{]"), F.regexp_replace(text, r"\{[^\[\]{}]*\}|\[[^\[\]{}]*\]", "o")).otherwise(text))


def one_value(text: Column) -> Column:
    """For a text that starts with a valid value: nothing but JSON's white
    space stands around it."""
    return F.btrim(closed(bare(text)), F.lit(" \t\n\r")).rlike(_TOKEN)


def is_json(text: Column) -> Column:
    """Whether a strict parser reads the text (repeated keys allowed)."""
    starts = F.try_parse_json(text).isNotNull() | F.from_json(text, "map<string,string>", OPTIONS).isNotNull()
    return F.when(starts, one_value(text)).otherwise(F.lit(False))


def element_kinds(array_text: Column) -> Column:
    """First letters of the elements of an array's text: ``s`` for a string."""
    text = F.btrim(bare(array_text), F.lit(" \t\n\r"))
    inner = closed(F.substring(text, F.lit(2), F.length(text) - 2))
    return F.transform(F.split(inner, ","), lambda x: F.substring(F.btrim(x, F.lit(" \t\n\r")), 1, 1))
