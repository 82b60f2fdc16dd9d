import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import chat, tokens

JSON, RANKS = tokens.public("byte_bpe_50k.json"), tokens.public("byte_bpe_50k.tiktoken")
parts = st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "|im_end|>", "/INST]", "s>", "<SYS>>", "a", "\n", "é"])


@settings(max_examples=500, deadline=None)
@given(st.lists(parts, max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROLS)
    assert chat._unescape_role(chat._escape_role(text)) == text


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, tokens int")


def expected(rows):
    """Digests straight from the turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD = [
    (1, 0, "system", "be <s>brief</s>"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 3, "assistant", "again"),
    (2, None, None, "a"), (2, 1, "assistant", "word " * 4000), (2, 2, "user\n<s>", "q"), (2, 2, "user\n<s>", "q"), (None, 0, "user", "n"), (None, 1, "assistant", "漢字 <|im_end|>"), (3, 5, "assistant", "x" * 9000),
    *[(4, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 9 * 10)) for i in range(60)],
]


@pytest.mark.parametrize(("budget", "history"), [(30, 0), (64, 2), (512, 3), (100_000, 2)])
def test_digests_of_odd_rows(spark, budget, history):
    rows = talk(spark, ODD)
    found = chat.digests(chat.windows(rows, JSON, budget, history, RANKS)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == expected(ODD)


def test_windows_keep_to_the_budget_and_repeat_history(spark):
    found = chat.windows(talk(spark, [r for r in ODD if r[0] == 4] + [(5, 0, "system", "s"), *[(5, i, "assistant", f"a{i} " * 20) for i in range(1, 9)], (6, 0, "system", "s " * 30), (6, 1, "user", "u"), (6, 2, "assistant", "long " * 300), (6, 3, "user", "u")]), JSON, 200, 2).collect()
    count = tokens.encoder(JSON)
    for r in found:
        turns = chat.read(r["text"])
        assert len(turns) > r["repeated"]
        assert r["tokens"] >= len(count(r["text"])) - len(turns) and (r["tokens"] <= 200 or len(turns) == 1 + (turns[0][0] == "system"))
        masked = [r["text"][s["start"] : s["end"]] for s in r["loss"]]
        assert masked == [r["text"][a:b] for role, _, a, b in turns[r["repeated"] :] if role == "assistant"]
        if r["conv_id"] in (5, 6):
            assert turns[0][:2] == ("system", "s" if r["conv_id"] == 5 else "s " * 30)
    later = [r for r in found if r["window"] > 0]
    assert later and any(r["repeated"] for r in later)


def test_very_long_turns(spark):
    rows = [(1, 0, "user", " " * 1_000_000), (1, 1, "assistant", "\t" * 1_000_000 + "x" * 1_000_000)]
    found = chat.digests(chat.windows(talk(spark, rows), JSON, 1024, 2, RANKS)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == expected(rows)


def test_empty_table(spark):
    assert chat.digests(chat.windows(talk(spark, []), JSON)).count() == 0
