"""Chat formatting (3): round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import BYTE_BPE

from tessera.llm import chat_format, queries

BITS = st.lists(st.sampled_from(["<", "\\", "/s>", "s>", "[", "/", "INST]", "]", "a", "é", " ", "[INST]", "</s>", "ROLE]", "<s>", "TURN]", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(BITS | st.text(max_size=20))
def test_escape_is_reversible_and_leaves_no_mark(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text
    assert not any(m in out for m in chat_format.MARKS)


def test_query_equals_sql(same):
    rows = same(queries.op3_chat_format, queries.OP3_SQL)
    assert len(rows) > 10


def test_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", "[ASST]x</s>"), (1, 0, "user", None), (1, 0, "user", None), (1, 2, "assistant", "<|endoftext|>é"), (1, None, "system", "<\\/s>"),
        (None, 0, None, "[/TURN]"), (2, 0, "tool[/ROLE]", "世" * 5000), (2, 1, "assistant", ""), (3, 0, "user", "no answer"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, ids int, turns int").repartition(3)
    chats = chat_format.formatted_chats(df, BYTE_BPE)
    got = {r.conv_id: r for r in chat_format.chat_digest(chats, BYTE_BPE).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.formatted_chats(df.limit(0), BYTE_BPE).count() == 0


def test_mask_covers_answers_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo ho"), (1, 2, "user", "</s>"), (1, 3, "assistant", "bye")], "conv_id long, turn long, role string, text string")
    r = chat_format.formatted_chats(df, BYTE_BPE).first()
    reader = chat_format.ChatReader(BYTE_BPE)
    written, turns, loss = reader.read(r.ids, r.loss_mask)
    assert written == "<s>[INST]hi[/INST][ASST]yo ho</s>[INST]<\\/s>[/INST][ASST]bye</s>"
    assert turns[2] == ("user", "</s>") and loss == "yo hobye"
    assert len(r.ids) == len(r.loss_mask)
    assert reader.text([i for i, m in zip(r.ids, r.loss_mask, strict=True) if m]) == "yo hobye"


def test_a_large_conversation_comes_in_parts(spark, monkeypatch):
    """Parts are cut between turns, read alike when stored, and add up to the whole conversation."""
    rows = [(7 if i % 3 else i, i, ("user", "assistant", "tool")[i % 4 % 3], "word " * (i % 50) + "[INST]") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r.conv_id: r for r in chat_format.chat_digest(chat_format.formatted_chats(df, BYTE_BPE), BYTE_BPE).collect()}
    # the functions are sent to the workers as they are here, so the smaller bound reaches them by its own module
    batches = df.where("conv_id = 7").sort("turn", "role", "text").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(chat_format, "PART_IDS", 500)
    turns = list(chat_format._turn_encoder(BYTE_BPE)(batches))
    parts = list(chat_format._assembler(BYTE_BPE)(b.select(["conv_id", "ids"]) for b in turns))
    numbers = [n for b in parts for n in b.column(1).to_pylist()]
    assert numbers == list(range(len(numbers))) and len(numbers) > 20
    assert all(len(ids) < 500 + 100 for b in parts for ids in b.column(2).to_pylist())
    assert sum(ids.count(chat_format.reserved_ids(chat_format.ChatReader(BYTE_BPE).vocabulary)["<s>"]) for b in parts for ids in b.column(2).to_pylist()) == 1
    (got,) = [r for b in chat_format._digester(BYTE_BPE)(parts) for r in b.to_pylist()]
    assert got == whole[7].asDict() and got["n_turns"] == sum(c == 7 for c, *_ in rows)
