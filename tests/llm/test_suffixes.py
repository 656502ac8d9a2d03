import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np

from tallyfield.llm import suffixes
from tallyfield.llm.keyed import maybe_among
from tallyfield.session import shared_dir
from tests.llm.tables import collected, documents


def brute(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[k] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def sample():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(1, 9)))
    passage = " ".join(word() for _ in range(200))
    texts = ["", "short", " ".join(word() for _ in range(900)), "a" * 1500, "é" * 450]
    texts += [f"{word()} {passage[i % 300 : 450 + 40 * i]} {word()} {word()}" for i in range(14)]
    texts += [passage, passage, passage[:399], passage[5:405], "ab" * 600, "xy" + "ab" * 199]
    return texts


def test_against_brute_force(spark, tmp_path):
    texts = sample()
    got = collected(suffixes.op8_suffixes(spark, documents(spark, tmp_path, [*((i, t, "s") for i, t in enumerate(texts)), (900, None, "s")])))
    want = brute({**{i: t.encode() for i, t in enumerate(texts)}, 900: b""})
    assert {i: tuple(r[1:5]) for i, r in got.items()} == want


def test_grams_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 3)
    texts = sample()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in suffixes.cut_repeats(d, length=60, gram=12).collect()}
    assert got == {i: x[1] for i, x in brute({i: t.encode() for i, t in enumerate(texts)}, 60).items()}


def repeated(parts, length):
    part, place, same = suffixes.equal_windows(parts, length)
    again = [set() for _ in parts]
    for x in np.flatnonzero(same):
        again[part[x]].add(int(place[x]))
        again[part[x - 1]].add(int(place[x - 1]))
    return [sorted(a) for a in again], [(i, a) for i, a, b in zip(part.tolist(), place.tolist(), same.tolist()) if not b]


def test_suffix_array_and_common_prefixes():
    r = random.Random(6)
    for n in (1, 2, 50, 300):
        parts = [bytes(r.choices(b"ab", k=n)) for _ in range(3)]
        again, _ = repeated(parts, 8)
        seen = Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
        assert again == [[i for i in range(len(p) - 7) if seen[p[i : i + 8]] > 1] for p in parts]


def test_suffix_array_sorts_to_the_end():
    r = random.Random(8)
    for n in (1, 5, 90):
        parts = [bytes(r.choices(b"abc\0\xff", k=n)) for _ in range(4)] + [b"", b"ab" * n]
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int32), 256 + i) for i, p in enumerate(parts)])
        plain = [int(x) - 256 if x >= 256 else int(x) + len(parts) for x in text]
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def test_runs_that_agree_beyond_the_length_and_then_differ():
    r = random.Random(0)
    parts = []
    for _ in range(160):  # 320 parts: the length sorted by doubles to 640
        same = bytes(r.choices(b"ab", k=r.randrange(650, 741)))
        parts += [same + x + bytes(r.choices(b"ab", k=749 - len(same))) for x in r.sample([b"x", b"y"], 2)]
    again, different = repeated(parts, 400)
    seen = Counter(p[i : i + 400] for p in parts for i in range(len(p) - 399))
    assert again == [[i for i in range(len(p) - 399) if seen[p[i : i + 400]] > 1] for p in parts]
    assert [parts[i][a : a + 400] for i, a in different] == sorted(seen)


def test_passages_are_what_repeats_over_fifty_words(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklm", k=r.randrange(4, 8)))
    long, short = " ".join(word() for _ in range(55)), " ".join(word() for _ in range(44))
    assert len(long) < 400 and len(short) >= 240
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{fill(80)} {long} {fill(30)}" for _ in range(9)] + [f"{fill(20)} {short} {fill(90)}" for _ in range(4)] + [fill(200), long, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for runs in (512, 2):  # one shard a gram, or several
        monkeypatch.setattr(suffixes, "SHARD_RUNS", runs)
        got = collected(suffixes.cut_repeats(d, passage=240))
        assert [len(got[i]["passages"]) for i in range(len(texts))] == [1] * 9 + [0] * 5 + [1, 0]
        p = got[3]["passages"][0]
        assert long.encode() in texts[3].encode()[p["start"] : p["end"]] and not any(x["spans"] for x in got.values())


def test_ids_beside_nulls_stay_exact(spark):
    d = spark.createDataFrame([(2**62 + 1, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in suffixes.cut_repeats(d).collect()) == sorted([str(2**62 + 1), "None", "None"])


def test_repeated_rows_and_empty_table(spark, tmp_path):
    sf = documents(spark, tmp_path / "a", [(1, "q" + "xyz" * 300, "s"), (1, "q" + "xyz" * 300, "s")])
    assert [r["n_removed"] for r in suffixes.op8_suffixes(spark, sf).collect()] == [901, 901]
    assert suffixes.op8_suffixes(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_rows_asked_for_are_never_left_out(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(None, "none")], "key long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] * 2, "key long")
    for bits in (1 << 20, 1 << 6):  # wide, and full
        told = {r["key"]: r["_among"] for r in maybe_among(rows, wanted, "key", bits).collect()}
        assert len(told) == 3001 and all(told[i] for i in range(0, 3000, 7))
        assert bits < 3000 or sum(told.values()) < 500
    assert not any(r["_among"] for r in maybe_among(rows, wanted.filter("false"), "key", 1 << 20).collect())


def test_only_spans_stay_on_disk(spark):
    passage = "".join(chr(97 + i * i % 23) for i in range(500))
    docs = spark.createDataFrame([(i, f"{i} own words {i * 7919} " * 60 + (passage if i % 10 == 0 else "")) for i in range(50)], "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "tallyfield"
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = {r["doc_id"]: len(r["spans"]) for r in suffixes.cut_repeats(docs).collect()}
    assert len(rows) == 50 and {i for i, n in rows.items() if n} >= {0, 10, 20, 30, 40}
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["repeat-spans"]
