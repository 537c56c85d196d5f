import hashlib

import pytest

from codecensus.llm.chat_format import (
    CONTROL, TemplateError, compile_template, escape, fold, format_conversations, parse, read_back, unescape,
    with_marked_conversation)


def render(source, messages):
    return "".join(p[0] for p in compile_template(source)(messages) if p)


MESSAGES = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


def test_template_language():
    source = ("<{{ 'a' + 'b' }}>{% for m in messages %}{% if loop.first %}F{% elif loop.last and not (m.role == 'user') %}L"
              "{% else %}?{% endif %}{{ loop.index0 + '/' + loop.index }}{{ m.text | upper }}{% endfor %}{% if 1 == 2 %}{% endif %}")
    with pytest.raises(TemplateError):
        parse(source)  # numbers are not in the language
    source = source.replace("1 == 2", "'1' == '2'")
    assert render(source, MESSAGES) == "<ab>F0/1HIL1/2YO"
    assert len(fold(parse("a{{ 'b' | upper }}{% if 'x' == 'x' %}c{% endif %}"))) == 1


@pytest.mark.parametrize("bad", ["{{ m.text }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open }}",
                                 "{% for m in messages %}", "{{ 'a' | eval }}", "{% import os %}", "{{ 'a' 'b' }}", "{{ }}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        parse(bad)


@pytest.mark.parametrize("text", ["", "\\", "\\\\[INST]", "".join(CONTROL), "[[INST]", "</s", "a\\</s>\n[/INST]", "<s></s><s>"])
def test_escape(text):
    assert unescape(escape(text)) == text


def test_round_trip(spark):
    rows = [(1, 0, "user", "hello\n[INST]"), (1, 1, "assistant", "x</s>"), (1, 2, "assistant", "\\é😀"), (1, 2, "user", None),
            (2, 0, None, ""), (3, 5, "assistant", "a" * 100_000), (3, 5, "assistant", "a" * 100_000), (3, None, "user", "first"),
            (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    formatted = format_conversations(with_marked_conversation(df.repartition(3)))
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    mark = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", mark), (-7, 1, "assistant", mark)]
    low = lambda x: (x is not None, x or 0)
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    sizes = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg({"piece": "count"}).toDF("conv_id", "n").collect()}
    assert sizes[9] == 3000
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_large_ids_beside_a_null(spark):
    ids = [2**53 + 1, -(2**63), 2**63 - 1, None]
    df = spark.createDataFrame([(i, 0, "user", "x") for i in ids], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r.conv_id for r in read_back(format_conversations(df)).collect()} == set(ids)
