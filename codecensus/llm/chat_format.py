"""Chat formatting by a small template compiler.

A template is text with ``{{ expression }}`` and the tags ``{% for m in
messages %}``, ``{% if %} {% elif %} {% else %}``, ``{% generation %}`` and
their ends. Expressions are string literals, names, the fields of a message
(``m.role``, ``m.text``) and of ``loop`` (``first``, ``last``, ``index``,
``index0``), ``==``, ``!=``, ``+``, ``not``, ``and``, ``or`` and filters. The
language is a sandbox: no other names, fields or filters exist, and nothing
can be called. The template is parsed into a syntax tree, constant parts are
folded, and the tree becomes nested Python closures that yield pieces of
text, each marked as generated (inside ``generation``) or not. Messages are
read one at a time, so a conversation is never held whole.

The ``escape`` filter puts a backslash before every control string (and every
backslash) of a text; ``unescape`` takes them off again.

Defined cases: a null text or role is empty; rows without a conversation id
form one conversation; rows of equal turn are ordered by role and text, and
repeated rows are turns of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import read

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)

_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class TemplateError(ValueError):
    pass


# ---- syntax tree -----------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class For:
    var: str
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: str(a) + str(b), "not": lambda a: not a,
} | {f"|{k}": (lambda f: lambda a: f(str(a)))(f) for k, f in FILTERS.items()}
MESSAGE_FIELDS, LOOP_FIELDS = ("role", "text"), ("first", "last", "index", "index0")

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+.|()]))")
_CHARS = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent: or, and, not, comparison, +, filters, atoms."""

    def __init__(self, source: str, names: tuple[str, ...]):
        self.tokens, self.names, at = [], names, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            self.tokens.append(("str", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
            at = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "str" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def parse(self):
        tree = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        tree = self.added()
        while op := self.take("==", "!="):
            tree = Op(op, (tree, self.added()))
        return tree

    def added(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Op("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            tree = Op(f"|{name}", (tree,))
        return tree

    def atom(self):
        if not self.tokens:
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _CHARS.get(m[1], m[1]), value[1:-1], flags=re.S))
        if (kind, value) == ("op", "("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return tree
        if kind == "name" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "name" and value in self.names and self.take("."):
            field = self.tokens.pop(0)[1] if self.tokens else ""
            if field not in (LOOP_FIELDS if value == "loop" else MESSAGE_FIELDS):
                raise TemplateError(f"no such field: {value}.{field}")
            return Field(value, field)
        raise TemplateError(f"not allowed here: {value!r}")


def _split(source: str) -> list[tuple[str, str]]:
    parts, at = [], 0
    for m in _PART.finditer(source):
        parts.append(("text", source[at:m.start()]))
        parts.append(("expr", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    return [*parts, ("text", source[at:])]


def parse(source: str) -> tuple:
    parts = _split(source)

    def block(names: tuple[str, ...], ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                nodes.append(Emit(Const(value)))
            elif kind == "expr":
                nodes.append(Emit(_Expression(value, names).parse()))
            elif value.split(" ")[0] in ends:
                return tuple(nodes), value
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", value):
                if names:
                    raise TemplateError("loops can't be nested")
                body, _ = block((m[1], "loop"), ("endfor",))
                nodes.append(For(m[1], body))
            elif m := re.fullmatch(r"if\s+(.*)", value, re.S):
                nodes.append(branch(m[1], names))
            elif value == "generation":
                body, _ = block(names, ("endgeneration",))
                nodes.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag: {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def branch(test: str, names: tuple[str, ...]) -> If:
        then, end = block(names, ("elif", "else", "endif"))
        if end.startswith("elif"):
            return If(_Expression(test, names).parse(), then, (branch(end[4:], names),))
        other = block(names, ("endif",))[0] if end == "else" else ()
        return If(_Expression(test, names).parse(), then, other)

    return block((), ())[0]


# ---- constant folding ------------------------------------------------------

def fold(node):
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        y = Emit(Const(str(out.pop().value.value) + str(y.value.value)))
                    if y.value.value == "":
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.name in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(OPS[node.name](*(a.value for a in args)))
        return Op(node.name, args)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.var, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# ---- closures --------------------------------------------------------------

def _value(node) -> Callable:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Field):
        return lambda env, of=node.of, name=node.name: env[of][name]
    args = [_value(a) for a in node.args]
    if node.name == "and":
        return lambda env, a=args[0], b=args[1]: a(env) and b(env)
    if node.name == "or":
        return lambda env, a=args[0], b=args[1]: a(env) or b(env)
    f = OPS[node.name]
    if len(args) == 1:
        return lambda env, f=f, a=args[0]: f(a(env))
    return lambda env, f=f, a=args[0], b=args[1]: f(a(env), b(env))


def _block(nodes: tuple, generated: bool) -> Callable:
    steps = [_step(n, generated) for n in nodes]

    def run(env):
        for step in steps:
            yield from step(env)

    return run


def _step(node, generated: bool) -> Callable:
    if isinstance(node, Emit):
        value = _value(node.value)
        return lambda env: ((str(value(env)), generated),)
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then, generated), _block(node.other, generated)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Generation):
        return _block(node.body, True)
    body = _block(node.body, generated)

    def loop(env):
        messages = iter(env["messages"])
        ahead = next(messages, None)
        index = 0
        while ahead is not None:
            message, ahead = ahead, next(messages, None)
            yield from body({node.var: message, "loop": {
                "first": index == 0, "last": ahead is None, "index": index + 1, "index0": index}})
            yield None  # a turn is over
            index += 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator]:
    """A function from messages (dicts with role and text) to an iterator of
    (text, generated) pieces, with None after each turn of a loop."""
    run = _block(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


# ---- Spark -----------------------------------------------------------------

#: Ids pass through pandas as text: beside a null, whole numbers would become
#: floating point there.
FORMATTED = "conv_id string, part long, piece string, spans array<struct<start:int,end:int>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted conversations as ordered parts, one per turn (and one
    for text outside a loop): conv_id, part, piece, and the spans of the
    piece that were generated (code points).

    Conversations are dealt out by id and sorted within tasks; a task streams
    its rows through the template, so the memory it needs is that of one turn.
    """
    parse(template)
    rows = conversations.select(
        F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        source = _Rows(frames)
        while not source.done():
            conv, part, text, spans, size, out, held = source.key(), 0, [], [], 0, [], 0
            for piece in render(source.conversation()):
                if piece is not None:
                    if piece[0]:
                        if piece[1]:
                            spans.append((size, size + len(piece[0])))
                        text.append(piece[0])
                        size += len(piece[0])
                    continue
                out.append((conv, part, "".join(text), spans))
                held += size
                part, text, spans, size = part + 1, [], [], 0
                if held > 1 << 20:
                    yield pd.DataFrame(out, columns=["conv_id", "part", "piece", "spans"])
                    out, held = [], 0
            if text or not part:
                out.append((conv, part, "".join(text), spans))
            source.skip()  # what the template has not read
            yield pd.DataFrame(out, columns=["conv_id", "part", "piece", "spans"])

    return dealt.mapInPandas(run, FORMATTED).withColumn("conv_id", F.col("conv_id").cast("long"))


class _Rows:
    """Rows of sorted frames, conversation by conversation."""

    def __init__(self, frames: Iterator[pd.DataFrame]):
        self.rows = ((c, r, t) for f in frames for c, r, t in zip(f["conv_id"], f["role"], f["text"], strict=True))
        self.ahead = next(self.rows, None)

    def done(self) -> bool:
        return self.ahead is None

    def key(self) -> str | None:
        return self.ahead[0]

    def conversation(self) -> Iterator[dict]:
        self.open = self.key()
        while self.ahead is not None and self.ahead[0] == self.open:
            _, role, text = self.ahead
            self.ahead = next(self.rows, None)
            yield {"role": role, "text": text}

    def skip(self) -> None:
        while self.ahead is not None and self.ahead[0] == self.open:
            self.ahead = next(self.rows, None)


_MARK = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROL)), re.S)


def turns_of(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted piece, unescaped."""
    marks = [m for m in _MARK.finditer(piece) if m[0][0] != "\\"]
    turns = []
    for k in range(0, len(marks) - 2, 3):
        opened, between, closed = marks[k:k + 3]
        if (opened[0], between[0], closed[0]) != ("[INST]", "[/INST]", "</s>"):
            raise ValueError("the formatted text has broken marks")
        turns.append((unescape(piece[opened.end():between.start()]), unescape(piece[between.end():closed.start()])))
    return turns


DIGESTS = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its spans say. A digest of a
    whole conversation is made in order; its parts stream through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, state = False, None
        conv = None

        def row():
            n, turns, chars, loss, total = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for frame in frames:
            out = []
            for c, piece, spans in zip(frame["conv_id"], frame["piece"], frame["spans"], strict=True):
                if not open_ or c != conv:
                    if open_:
                        out.append(row())
                    open_, conv, state = True, c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(piece[span["start"]:span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
            if out:
                yield _digests(out)
        if open_:
            yield _digests([row()])

    texts = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    return texts.mapInPandas(run, DIGESTS).withColumn("conv_id", F.col("conv_id").cast("long"))


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGESTS.split(", ")])


def with_marked_conversation(conversations: DataFrame) -> DataFrame:
    """All conversations and number -7, whose texts look like marks."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.sql(
        f"SELECT CAST(-7 AS long) conv_id, t.turn, t.role, '{said}' text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text")
    return rows.unionByName(extra)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return read_back(format_conversations(with_marked_conversation(read(spark, sf_dir, "conversations"))))
