"""The pipeline's stages, each on what its predecessor kept, against brute force over all pairs."""

import random
import re

from xxhash import xxh64_intdigest

import corpus_pipeline
from tessera.llm import common, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    """200 documents: distinct ones, toxic ones, copies, near copies, shared lines, passages of a benchmark item, an empty and a null text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    line = lambda n=14: " ".join(word() for _ in range(n)) + "."
    item, shared = line(24), line()
    texts = ["\n".join(line() for _ in range(4)) for _ in range(200)]
    for i in range(0, 60, 2):
        texts[i] += "\nyou wretched scoundrel, begone."
    for i in (101, 102, 103):
        texts[i] = texts[100]
    for i in (111, 112):
        texts[i] = "\n".join([*texts[110].split("\n")[:3], texts[110].split("\n")[3][:-1] + " x."])
    for i in range(120, 130):
        texts[i] += "\n" + shared + "!" * (i % 2)
    for i in (140, 141):
        texts[i] += "\n" + line(3) + " " + item + " " + line(3 + i % 2 * 20)
    texts[150], texts[151] = "", None
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write(rows, DOCS, "documents")
    write([(i, 1, int(i < 60 and i % 2 == 0)) for i in range(100)], "doc_id long, quality int, toxic int", "labels")
    write([(1, item), (2, None), (3, line(12))], "item_id long, text string", "benchmark")


def joined(nodes, linked):
    """The least node reachable from each."""
    root = {n: n for n in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if root[a] != root[b] and linked(a, b):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


def without_repeated_lines(rows):
    def alike(x, y):
        return len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y])

    lines = [(i, n, " ".join(x.lower().split())) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    first = {}
    for at, (_, _, x) in enumerate(lines):
        if x:
            first.setdefault(x, at)
    grams = {at: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x, at in first.items()}
    root = joined(list(grams), alike)
    kept = {(i, n) for at, (i, n, x) in enumerate(lines) if not x or root[first[x]] == at}
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in kept) for i, t in rows}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[i : i + 10]) for i in range(len(words) - 9)}


def test_stages(spark, tmp_path):
    tables(spark, tmp_path)
    where = str(tmp_path)
    docs = common.read(spark, where, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        docs = common.materialize(stages[name](spark, docs, where))
        assert name == "mixing" or docs.columns == columns
        return {r.doc_id: r.text for r in docs.collect()} if name != "mixing" else docs.collect()

    before = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, common.read(spark, where, "labels"))
    kept = step("toxicity")
    assert kept == {i: t for i, t in before.items() if model.score(t or "") < 0.5}
    assert set(before) - set(kept) == set(range(0, 60, 2))

    want = without_repeated_lines(sorted(kept.items()))
    assert want != kept
    kept = step("line_dedup")
    assert kept == want

    prints = {i: fingerprint(t) for i, t in kept.items()}
    root = joined(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    want = {i: t for i, t in kept.items() if root[i] == i}
    assert len(want) < len(kept)
    kept = step("simhash")
    assert kept == want

    items = set().union(*(windows(r.text) for r in common.read(spark, where, "benchmark").collect()))
    want = {i: t for i, t in kept.items() if not windows(t) & items}
    assert len(want) < len(kept)
    kept = step("decontamination")
    assert kept == want

    mixed = {r.doc_id: r for r in step("mixing")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in kept.items()}
    assert {i: r["size"] for i, r in mixed.items()} == size
    assert all(0 <= r.taken <= 2 * r["size"] for r in mixed.values())
    targets = {i % 3: r.target for i, r in mixed.items()}
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-3
    assert abs(sum(r.taken for r in mixed.values()) - sum(targets.values())) <= len(targets)
