import random
import re

from tallyfield.llm import minhash
from tests.llm.tables import collected, documents

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, width=4):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    moved = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def test_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = {0: "", 1: None, 2: " \t\n", 3: "one", 4: "ONE", 5: "one two", 6: "É one two three", 7: "é one two three", 8: "a b c"}
    for g in range(6):
        base = [f"w{r.randrange(3000)}" for _ in range(120)]
        for k in range(25):
            words = list(base)
            for _ in range(r.randrange(8)):  # near the threshold from both sides
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            texts[100 + 25 * g + k] = " ".join(words)
    sf = documents(spark, tmp_path, [(i, t, "s") for i, t in texts.items()])
    got = collected(minhash.op9_minhash(spark, sf))
    assert {i: tuple(r[1:]) for i, r in got.items()} == brute(texts)


def test_blocks_of_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 4)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {i: " ".join(x if r.random() > 0.02 else f"z{r.randrange(10**6)}" for x in base) for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collected(minhash.near_duplicates(d, width=4))
    assert {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in got.items()} == brute(texts)


def test_signatures_estimate_similarity():
    a = [f"w{i}" for i in range(400)]
    sets = minhash.shingle_sets([" ".join(a), " ".join(a[:380] + ["x"] * 20)])
    true = len(set(sets[0].tolist()) & set(sets[1].tolist())) / len(set(sets[0].tolist()) | set(sets[1].tolist()))
    sig = minhash.signatures(sets)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


def test_dropping(spark):
    d = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "a b c d e f g", 2), (None, "a b c d e f g", 3), (3, None, 4), (4, "", 5)], "doc_id long, text string, component int")
    out = minhash.drop_near_duplicates(d)
    assert out.columns == d.columns
    assert sorted(r["component"] for r in out.collect()) == [2, 3, 4, 5]


def test_empty_table(spark, tmp_path):
    assert minhash.op9_minhash(spark, documents(spark, tmp_path, [])).count() == 0


def test_ids_with_several_texts_link_what_any_of_them_does(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, None), (4, c), (5, c + " z"), (5, ""), (None, a), (6, "other words of its own"), (6, "other words of its own")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = minhash.near_duplicates(d)
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()), key=repr) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (6, 6, True), *[(None, r["component_id"], r["kept"]) for r in got.filter("doc_id IS NULL").collect()]], key=repr)
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(d).filter("doc_id IS NOT NULL").collect()) == [1, 4, 6]
