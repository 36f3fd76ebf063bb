"""Whole jobs: inputs on which a bound, a key or a rule once left part of the work undone."""

import json
import random

import corpus_pipeline
from tessera.llm import lines, tool_calls, toxicity


def chain(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def calls(*each):
    return json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": "{}", "after": after} for i, after in each]})


def test_long_reversed_chains(spark):
    n = 30
    one = [(1, 0, "assistant", calls(*((f"a{i}", [f"a{i + 1}"] if i < n - 1 else []) for i in range(n))))]
    turns = [(2, i, "assistant", calls((f"b{i}", [f"b{i + 1}"] if i < n - 1 else []))) for i in range(n)]
    loop = [(3, 0, "assistant", calls(("x", ["y"]), ("y", ["x"]), ("s", ["s"]), ("p", ["q"]), ("q", ["y"]), ("r", [])))]
    got = {r.call_id: r for r in tool_calls.linked_calls(chain(spark, one + turns + loop), {"f": {"type": "object"}}).collect()}
    for k in "ab":
        assert [got[f"{k}{i}"].position for i in range(n)] == [*range(n - 1, -1, -1)]
        assert all(got[f"{k}{i}"].problems == [] and got[f"{k}{i}"].status == "pending" for i in range(n))
    assert {k for k in "xyspqr" if "cycle" in got[k].problems} == {"x", "y", "s"}
    assert sorted("xyspqr", key=lambda k: got[k].position) == list("xysqrp")


def test_equal_places(spark):
    """A call that is moved stays behind one of a later turn that is moved to the same place."""
    rows = [(1, 3, "assistant", calls(("m", []), ("a", ["n", "z"]))), (1, 4, "assistant", calls(("n", ["z"]))), (1, 5, "assistant", calls(("z", [])))]
    got = {r.call_id: r.position for r in tool_calls.linked_calls(chain(spark, rows), {"f": {"type": "object"}}).collect()}
    assert got["z"] < got["n"] < got["a"]


def test_dedup_lines_takes_any_ids(spark):
    same, other = "a line that is long enough to count", "something else entirely, and long too"
    rows = [(1, same + "\n" + other, 9), (1, other, 8), (1, other, 7), (2, same, 6), (None, same + "\nonly here, in the null row", 5), (None, None, 4), (3, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    got = {r.uid: (r.doc_id, r.text) for r in lines.dedup_lines(df).collect()}
    want = {r["doc_id"]: 0 for r in lines.removed_lines(df).collect()}
    assert set(want) == {1, 2, 3, None} and len(got) == len(rows)
    kept = [x for _, t in got.values() for x in (t or "").split("\n") if x]
    assert kept.count(same) == 1 and kept.count("only here, in the null row") == 1
    assert [got[8], got[7]] in ([(1, other)] * 2, [(1, "")] * 2)
    assert got[6] == (2, "") and got[4] == (None, None) and got[3] == (3, None)


def test_near_copies_by_shingles(spark):
    """The stage against brute force over all pairs: 5-word Jaccard of 0.8, in chains, and pairs just under it."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n in [60, 150, 400] * 12:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (n // 60, n // 42, n // 25):
            own = list(base)
            for at in r.sample(range(n), edits):
                own[at] = word()
            texts.append("  ".join(own).upper())
    texts += ["a b c d", "a b c d e", "A b c\nd", "", None, " \n"]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root, linked = [grams(t) for t in texts], list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert linked > 25
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == {i: t for i, t in enumerate(texts) if root[i] == i}


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 0), (7, a + " x", 1), (7, b, 2), (7, "three", 3), (7, "three", 3), (None, a, 4), (None, "alone in here", 5), (None, b, 6), (8, "three", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int").repartition(4)
    got = sorted(x.uid for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == [0, 2, 3, 5]


def test_training_reads_whole_texts(spark, monkeypatch):
    """A long text whose offence is beyond any prefix teaches it; a budget of characters takes fewer whole texts."""
    calm = "what a nice day it was. " * 1000
    rows = [(i, calm + ("you wretched scoundrel." if i % 2 else "")) for i in range(40)] + [(1, calm + "you wretched scoundrel.")] * 2 + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score("oh you wretched scoundrel.") > 0.5 > model.score("what a nice day it was.")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.extend(texts))
    monkeypatch.setattr(toxicity, "MAX_TRAIN_CHARS", 100_000)
    toxicity.fit(docs, labels)
    assert 4 <= len(seen) <= 5 and set(seen) <= {t or "" for _, t in rows}
