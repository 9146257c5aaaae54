import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seismark.llm import queries
from seismark.llm.chat_format import ChatTemplate, format_conversations, read_back
from tests.conftest import TINY, canonical

T = ChatTemplate()


def test_matches_sql(spark, oracle):
    assert canonical(queries.op8_chat_format(spark, TINY).toPandas()) == oracle(queries.OP8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "im_start", "|>", "<|im_end|>", "\\", "</s>", "[INST]", "[", "INST]", "s>", "/", "<<SYS>>", "\n", "é", "😀", "x"]), max_size=12).map("".join))
def test_escapes(text):
    import pyarrow as pa

    a = T.escape(pa.array([text]))[0].as_py()
    assert T.unescape(a) == text and not any(c in a for c in T.controls)
    role = T.escape_roles(pa.array([text]))[0].as_py()
    assert T.unescape_role(role) == text and "\n" not in role


def test_cases(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "assistant", "yo 😀 </s>"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, None, "to\nol", "a" * 100_000), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (4, 0, "assistant", "b")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <s>") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    parts = format_conversations(df.repartition(5))
    whole = {}
    for p in sorted(parts.collect(), key=lambda p: p.part):
        whole[p.conv_id] = whole.get(p.conv_id, "") + p.formatted
        for s in p.loss_spans:
            assert T.unescape(p.formatted[s.start : s.start + s.length]) in {r[3] or "" for r in rows if r[2] == "assistant"}
    got = {r.conv_id: r for r in read_back(parts).collect()}
    assert len(got) == 6
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in own]
        assert list(T.turns(whole[conv])) == said
        learnt = "".join(t for role, t in said if role == "assistant")
        want = (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole[conv]))
        assert tuple(got[conv])[1:] == want
    assert read_back(format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        ChatTemplate(controls=("<|im_start|>",))
