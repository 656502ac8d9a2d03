"""Extra columns whose names an operator uses itself change nothing, and repeated rows are a row each."""

import pytest

from tallyfield.llm import chat, gif, minhash, packing, suffixes
from tests.llm.tables import table
from tests.support import spark_rows

NAMES = ["key", "gram", "content", "shard", "starts", "spans", "kept", "lo", "hi", "width", "digest", "words", "band", "sketch", "size", "n", "length", "piece", "start", "offset", "sequence_id", "payload", "feature", "media", "first", "turns", "valid", "formatted", "component_id", "n_bytes", "count", "rank"]


def both(spark, tmp_path, name, rows, schema):
    """Folders of the same table without and with the extra columns."""
    for part in ("plain", "clash"):
        (tmp_path / part).mkdir()
    extra = ", ".join(f"{c} string" for c in NAMES)
    return table(spark, tmp_path / "plain", name, rows, schema), table(spark, tmp_path / "clash", name, [(*r, *NAMES) for r in rows], f"{schema}, {extra}")


@pytest.mark.parametrize("operator", [gif.op3_gif, packing.op4_pack, suffixes.op8_suffixes, minhash.op9_minhash])
def test_documents_with_clashing_columns_and_repeated_rows(spark, tmp_path, operator):
    copy = " ".join(f"word{i}" for i in range(90))
    rows = [(1, copy, "s"), (2, copy + " more", "s"), (3, None, None), (4, "", "t"), (5, "é short", "t"), (6, copy, "s"), (6, copy, "s")]
    plain, clash = both(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    want = spark_rows(operator(spark, plain).drop("sequence_id", "offset"))
    assert spark_rows(operator(spark, clash).drop("sequence_id", "offset")) == want and len(want) >= len({r[0] for r in rows})


def test_conversations_with_clashing_columns(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 0, "user", None)]
    plain, clash = both(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    assert spark_rows(chat.op10_chat(spark, clash)) == spark_rows(chat.op10_chat(spark, plain))
