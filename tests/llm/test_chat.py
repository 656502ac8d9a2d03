import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tallyfield.llm import chat
from tests.llm.tables import collected, table
from tests.support import DATA, difference

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert difference(chat.op10_chat(spark, sf), chat.OP10_SQL, sf) == ""


def test_edges(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\\<|"), (2, 0, "assistant", "x"), (3, 0, "user", "é" * 100_000), (3, 1, "assistant", ""), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (5, 0, None, "x")]
    sf = table(spark, tmp_path, "conversations", rows, SCHEMA)
    got = collected(chat.op10_chat(spark, sf), "conv_id")
    assert set(got) == {-1, 1, 2, 3, 4, 5}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\n\nassistant\n<|im_end|>\\<|\n") and got[1]["loss_sha256"] == digest("<|im_end|>\\<|")
    assert got[4]["turns_sha256"] == digest("user\na\nassistant\nb\n") and got[4]["valid"] and not got[2]["valid"]
    said = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1]["n_turns"], got[-1]["loss_chars"]) == (2, len(said))
    assert difference(chat.op10_chat(spark, sf), chat.OP10_SQL, sf) == ""


@given(st.text(alphabet=st.sampled_from("<|>\\im_startend\nrole ")), st.sampled_from(["user", "assistant", "system", "tool"]))
def test_escapes_are_reversible(text, role):
    t = chat.Template()
    assert t.unguard(t.guard(text)) == text
    formatted = "".join(s for s, _ in t.segments(role, text))
    assert list(t.parse(formatted)) == [(role, text)]


def test_empty_table_still_has_the_fixed_conversation(spark, tmp_path):
    assert [r["conv_id"] for r in chat.op10_chat(spark, table(spark, tmp_path, "conversations", [], SCHEMA)).collect()] == [-1]
