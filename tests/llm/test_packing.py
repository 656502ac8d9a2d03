import zlib

import numpy as np
from tokenizers import Tokenizer

from tallyfield.llm import packing
from tests.llm.tables import documents
from tests.support import DATA


def check(rows, texts):
    encoder = Tokenizer.from_file(packing.vocabulary())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in pieces] == [(k, 2048 * k) for k in range(-(-len(ids) // 2048))]
        for r in pieces:
            own = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(own), zlib.crc32(own.tobytes()))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by_sequence), -(-sum(r["length"] for r in rows) // 2048)


def test_small_table_with_edges(spark, tmp_path):
    texts = {0: "", 1: None, 2: "Hello  WORLD", 3: "word " * 9000, 4: "<|startoftext|> é 中文   x", 5: "!!!???...", 6: "a" * 5000, 7: "don't we'll 123 4567"}
    rows = packing.op4_pack(spark, documents(spark, tmp_path, [(i, t, "s") for i, t in texts.items()])).collect()
    used, least = check(rows, texts)
    assert used <= least + 1


def test_whole_table(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check(packing.op4_pack(spark, sf).collect(), texts)
    assert used <= 1.01 * least + 1


def test_exact_complements_are_found():
    plan = packing.ComplementPlan({1000: 1, 600: 1, 448: 1, 2000: 1, 48: 1, 1024: 2}, 2048)
    assert sum(n for _, n in plan.patterns) == 3 and all(sum(p) == 2048 for p, _ in plan.patterns)


def test_short_lengths_share_sequences():
    assert sum(n for _, n in packing.ComplementPlan({100: 1000}, 2048).patterns) == 50
    assert sum(n for _, n in packing.ComplementPlan({1: 5000, 512: 7}, 2048).patterns) == 5


def test_repeated_rows_and_empty_table(spark, tmp_path):
    sf = documents(spark, tmp_path / "a", [(1, "x y", "s"), (1, "x y", "s")])
    assert packing.op4_pack(spark, sf).count() == 2
    assert packing.op4_pack(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_words_that_hide_their_ends_go_through_the_tokenizer_itself():
    own = packing.WordTokenizer(packing.vocabulary())
    own.ends = np.zeros_like(own.ends)
    exact = Tokenizer.from_file(packing.vocabulary())
    texts = ["the quick brown fox", "Hello  WORLD !!!???... 123", "x" * 300 + " again the fox"]
    assert [x.tolist() for x in own.encode(texts)] == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_beside_nulls_stay_exact(spark):
    d = spark.createDataFrame([(2**62 + 1, "a b"), (None, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.token_pieces(d, packing.vocabulary()).collect()} == {2**62 + 1, None}
    assert {r["doc_id"] for r in packing.pack_documents(d).collect()} == {2**62 + 1, None}
