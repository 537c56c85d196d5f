"""Line metrics of very large files by pieces.

A file is cut into pieces of bounded length. A piece is summed up on its own:
the lines that lie whole in it, and what it holds of its first and its last
line. Such a fragment is three facts (white space at its start, the first
letters behind that, its first letters) which say all that the line rules
ask, and two fragments in a row make one by an associative rule. So a file's
pieces may be worked on in different tasks; only their summaries meet, in
order, and no array of all lines of a file ever exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as S
from codecensus.functions.text import WS, is_blank, lines_of
from codecensus.operators.classify import lookup
from codecensus.operators.metrics import comment_test, metric_columns

PIECE = 1 << 20
#: Letters that tell a comment: the longest mark.
MARK = max(len(m) for marks in [*rules.COMMENT_PREFIXES.values(), rules.DEFAULT_COMMENT_PREFIXES] for m in marks)
FRAGMENT = "struct<ws:bigint,solid:string,head:string>"
STATE = f"struct<lines:bigint,blank:bigint,comment:bigint,indent:bigint,open:{FRAGMENT}>"


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, f"^{WS}*", 0)).cast("bigint")


def fragment(text: Column) -> Column:
    ws = _indent(text)
    return F.struct(ws.alias("ws"), F.substring(text, (ws + 1).cast("int"), F.lit(MARK)).alias("solid"), F.substring(text, 1, MARK).alias("head"))


def joined(a: Column, b: Column) -> Column:
    """The fragment of two fragments in a row."""
    blank = a["solid"] == ""
    return F.struct(F.when(blank, a["ws"] + b["ws"]).otherwise(a["ws"]).alias("ws"),
                    F.when(blank, b["solid"]).otherwise(F.substring(F.concat(a["solid"], b["head"]), 1, MARK)).alias("solid"),
                    F.substring(F.concat(a["head"], b["head"]), 1, MARK).alias("head"))


def _closed(state: Column, line: Column, language: Column) -> dict[str, Column]:
    """Counts after a line whose fragment is ``line``."""
    blank = line["solid"] == ""
    comment = ~blank & comment_test(language, line["solid"])
    return {"lines": state["lines"] + 1, "blank": state["blank"] + blank.cast("bigint"),
            "comment": state["comment"] + comment.cast("bigint"),
            "indent": F.when(blank, state["indent"]).otherwise(F.greatest(state["indent"], line["ws"]))}


def piece_summaries(contents: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a piece: its whole lines summed up, its first and last fragment
    (``last`` NULL where the piece has no line end)."""
    cut = contents.select("repo", "path", "file_seq", "language",
                          F.posexplode(F.regexp_extract_all("content", F.lit(f"(?s).{{1,{piece}}}"), 0)).alias("pos", "text"))
    lines = cut.select("repo", "path", "file_seq", "language", "pos", lines_of("text").alias("_lines"))
    split = lines.withColumn("_whole", F.slice("_lines", 2, F.greatest(F.size("_lines") - 2, F.lit(0))))
    solid = F.filter("_whole", lambda line: ~is_blank(line))
    return split.select(
        "repo", "path", "file_seq", "language",
        F.struct(F.col("pos"), F.size("_whole").cast("bigint").alias("lines"), (F.size("_whole") - F.size(solid)).cast("bigint").alias("blank"),
                 F.size(F.filter(solid, lambda line: comment_test(F.col("language"), line))).cast("bigint").alias("comment"),
                 F.coalesce(F.array_max(F.transform(solid, _indent)), F.lit(-1).cast("bigint")).alias("indent"),
                 fragment(F.col("_lines")[0]).alias("first"),
                 F.when(F.size("_lines") > 1, fragment(F.element_at("_lines", -1))).alias("last")).alias("piece"))


def file_metrics_by_pieces(contents: DataFrame, piece: int = PIECE) -> DataFrame:
    """``file_metrics`` with files of more than ``piece`` letters taken by
    pieces; shorter ones stay in their row."""
    known = (contents.select("repo", "path", "file_seq", "content", lookup(rules.LANGUAGE_EXTENSIONS, S.suffix("path")).alias("language"))
             .where(F.col("language").isNotNull() & (F.length("content") > 0)))
    short = known.where(F.length("content") <= piece).select("repo", "path", "file_seq", "language", lines_of("content").alias("_lines"))
    keys = ["repo", "path", "file_seq", "language"]
    in_row = short.select(*keys, *metric_columns(F.col("_lines"), F.col("language")))

    pieces = (piece_summaries(known.where(F.length("content") > piece), piece)
              .groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("pieces")))
    language = F.col("language")
    start = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("lines", "blank", "comment")], F.lit(-1).cast("bigint").alias("indent"),
                     fragment(F.lit("")).alias("open")).cast(STATE)

    def add(state: Column, p: Column) -> Column:
        line = joined(state["open"], p["first"])
        own = _closed(state, line, language)
        ended = F.struct((own["lines"] + p["lines"]).alias("lines"), (own["blank"] + p["blank"]).alias("blank"),
                         (own["comment"] + p["comment"]).alias("comment"), F.greatest(own["indent"], p["indent"]).alias("indent"),
                         p["last"].alias("open")).cast(STATE)
        goes_on = F.struct(*[state[c].alias(c) for c in ("lines", "blank", "comment", "indent")], line.alias("open")).cast(STATE)
        return F.when(p["last"].isNull(), goes_on).otherwise(ended)

    def finish(state: Column) -> Column:
        own = _closed(state, state["open"], language)
        return F.struct(*[c.alias(n) for n, c in own.items()])

    total = pieces.select(*keys, F.aggregate("pieces", start, add, finish).alias("t"))
    step = F.when(language == "Python", F.lit(4)).otherwise(F.lit(2))
    whole = total.select(
        *keys, F.col("t.lines").alias("lines"), F.col("t.blank").alias("blank_lines"), F.col("t.comment").alias("comment_lines"),
        (F.col("t.lines") - F.col("t.blank") - F.col("t.comment")).alias("code_lines"),
        F.floor(F.greatest(F.col("t.indent"), F.lit(0)) / step).cast("int").alias("max_indentation"))
    return in_row.unionByName(whole)
