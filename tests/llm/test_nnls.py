import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyfield.llm import nnls, queries
from tests.llm.tables import documents
from tests.support import DATA


def check(rows, texts):
    """Holds rows against the tokenizer itself: every id once, no gaps, no padding. Returns how many sequences and pieces there are."""
    encoder = Tokenizer.from_file(nnls.vocabulary())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(own.tobytes()), len(ids)) and len(own) == r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0  # full, or full at a smaller power of two
    return len(by_sequence), sum(r["length"] for r in rows)


def test_small_table_with_edges(spark, tmp_path):
    texts = {0: "", 1: None, 2: "Hello  WORLD", 3: "word " * 9000, 4: "a<|endoftext|>b<|endoftext|>", 5: "!!!???...", 6: "ab" * 50_000, 7: "don't we'll 123 4567", 8: "é 中文   x\x1f \x85 \U0001f600", 9: "   \n\n\t "}
    used, tokens = check(nnls.op12_windows(spark, documents(spark, tmp_path, [(i, t, "s") for i, t in texts.items()])).collect(), texts)
    assert used <= tokens // 2048 + 11


def test_whole_table(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_windows"](spark, sf).collect()
    used, tokens = check(rows, texts)
    assert used <= tokens // 2048 + 11
    assert len(rows) <= sum(-(-r["doc_tokens"] // 2048) for r in rows if r["start"] == 0) + 0.25 * len(texts)  # few pieces besides those that length asks for


def test_repeated_rows_null_ids_extra_columns_and_empty_table(spark, tmp_path):
    d = spark.createDataFrame([(2**62 + 1, "a b c", 1, 2), (2**62 + 1, "a b c", 1, 2), (None, "d", 3, 4)], "doc_id long, text string, row long, length long")
    rows = nnls.pack_windows(d).collect()
    assert {r["doc_id"] for r in rows} == {2**62 + 1, None}
    whole = {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in (2**62 + 1, None)}
    assert whole == {2**62 + 1: 8, None: 2}
    assert nnls.op12_windows(spark, documents(spark, tmp_path, [])).count() == 0


def covered(counts, capacity):
    """Follows every piece through the plan's runs: sequences by number, and that each token lies in one."""
    plan = nnls.WindowPlan(counts, capacity)
    runs = [tuple(map(int, r)) for r in plan.table()]
    at = {}
    for length, n in counts.items():
        for rank in range(n):
            todo = [(length, rank)]
            while todo:
                own, r = todo.pop()
                first = max(x for x in runs if x[0] == own and x[1] <= r)
                _, begin, sequence, offset, take, rest = first
                at.setdefault(sequence + r - begin, []).append((offset, take))
                if take < own:
                    todo.append((own - take, rest + r - begin))
    for parts in at.values():
        end = 0
        for offset, take in sorted(parts):
            assert offset == end
            end += take
        assert end <= capacity and end & (end - 1) == 0
    assert sum(t for parts in at.values() for _, t in parts) == sum(k * n for k, n in counts.items())
    assert len(at) == plan.sequences
    return plan


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_any_histogram_is_packed_without_padding(counts):
    covered(counts, 64)


def test_combinations_of_a_planted_histogram_are_found_without_cuts():
    plan = covered({40: 30, 24: 30, 30: 20, 20: 20, 14: 20}, 64)
    assert plan.cuts == 0 and plan.sequences == 50


def test_plan_does_not_grow_with_the_counts():
    small, large = nnls.WindowPlan({k: k % 7 + 20 for k in range(1, 2048)}), nnls.WindowPlan({k: 10**7 * (k % 7 + 20) for k in range(1, 2048)})
    assert len(large.runs) < 400_000 and small.total == large.total == 0
    assert large.cuts < 0.05 * 10**7 * sum(k % 7 + 20 for k in range(1, 2048))


@pytest.mark.parametrize("planted", [[3.0, 0.0, 7.0], [0.0, 5.0, 5.0]])
def test_solver_finds_planted_repeats(planted):
    columns = np.array([[5, 3, 0], [4, 4, 0], [4, 2, 2]])
    counts = np.zeros(9)
    for c, x in zip(columns, planted):
        for i in c:
            counts[i] += x
    assert np.allclose(nnls.solve(columns, counts, steps=5000), planted, atol=0.05)
