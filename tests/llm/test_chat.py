import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticelu.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PIECES = st.lists(st.sampled_from(["<", "|", "<|", "\\", "\n", "n", "<|im_end|>", "<|im_start|>", "assistant", ">", "é", " ", "\r\n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_turns_come_back(turns):
    line = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse_turns(line)] == turns
    assert line.count("<|im_start|>") == line.count("<|im_end|>") == len(turns)


def plain(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = lambda v: "".join(t for r, t in v if r == "assistant")
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss(v)), sha(loss(v))) for c, v in out.items()}


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.expand(df)).collect()}


def test_query(spark, sf_dir):
    from latticelu.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat(spark, sf_dir).collect()}
    assert found == plain(rows) and found[-1][2] == len(queries.CONTROL_TEXT)


def test_every_assistant_turn_is_an_example_with_all_before_it(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<|im_end|>"), (1, 2, "assistant", "b\\"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "left over"), (2, 0, "user", "only"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, SCHEMA)
    rows_out = chat.expand(df).collect()
    assert {r.chunks for r in rows_out} == {0} and [r.text for r in rows_out if r.target_start is None and r.conv_id == 2] == [chat.format_turn("user", "only")[0]]
    assert [len(chat.parse_turns(r.text)) for r in rows_out if r.conv_id == 1] == [3, 5, 6]
    whole = {(r.conv_id, r.example): r for r in rows_out if r.target_start is not None}
    assert set(whole) == {(1, 0), (1, 1), (3, 0)}
    for (conv, k), r in whole.items():
        turns = [(role, text) for c, _, role, text in rows if c == conv]
        ends = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [t[:2] for t in chat.parse_turns(r.text)] == turns[: ends[k] + 1]
        assert chat.unescape(r.text[r.target_start : r.target_end]) == turns[ends[k]][1]
    assert digest(df) == plain(rows)


def test_long_conversations_share_chunks(spark):
    rows = [(5, k, "assistant" if k % 3 == 2 else "user", f"{k} " + "x" * 1000) for k in range(250)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = chat.expand(df, chunk=20_000).collect()
    chunks = {r.chunks: r.text for r in found if r.example is None}
    assert len(chunks) > 10 and max(len(r.text) for r in found) < 22_000
    whole = {r.example: "".join(chunks[c] for c in range(r.chunks)) + r.text for r in found if r.example is not None}
    plainly = {r.example: r.text for r in chat.expand(df).collect()}
    assert whole == plainly and len(whole) == 84  # the same examples, whatever the chunk
    d = chat.digest(chat.expand(df, chunk=20_000)).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in d] == list(plain(rows).values()) and d[0].n_examples == 83


def test_one_very_long_text_and_a_broken_context(spark):
    rows = [(5, 0, "user", "<|" * 600_000), (5, 1, "assistant", "y" * 2_000_000), (5, 2, "assistant", "z")]
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    bad = spark.createDataFrame([(1, 0, 0, chat.format_turn("user", "a")[0], None, None), (1, 1, 0, chat.format_turn("user", "b")[0], None, None)], chat.EXAMPLES)
    with pytest.raises(Exception, match="context is not the turns before it"):
        chat.digest(bad.coalesce(1)).collect()


def test_nulls_ties_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, 1, "user", None), (None, 1, None, "x"), (1, None, "assistant", "z"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", example int")
    assert digest(df) == plain(rows)
    assert chat.digest(chat.expand(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.parse_turns("junk")
