"""Every opN query on the smallest tables, against its SQL or brute force in plain Python."""

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import pytest

from tessera.llm import common, fingerprints, lines, queries, substrings, tool_calls, toxicity

SF = "/root/testdata/sf0.001"
DUCK = duckdb.connect()
for name in ("documents", "pages", "benchmark"):
    at = f"{SF}/{name}.parquet"
    DUCK.execute(f"create view {name} as select * from read_parquet('{at}/*.parquet')" if os.path.isdir(at) else f"create view {name} as select * from read_parquet('{at}')")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()}


def shown(v):
    return f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    found = DUCK.execute(queries.oracle_sql()[name])
    names = sorted(x[0] for x in found.description)
    at = [[x[0] for x in found.description].index(n) for n in names]
    want = sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(map(shown, r)) for r in queries.queries()[name](spark, SF).select(*names).collect()) == want


def test_every_query_is_known():
    assert sorted(queries.queries()) == sorted(["op1_warc", "op2_tool_calls", "op3_toxicity", "op4_simhash", "op5_fingerprints", "op6_decontamination", "op7_line_dedup", "op8_token_counts", "op9_substrings", "op10_mixing"])


def test_op2(spark):
    got = queries.queries()["op2_tool_calls"](spark, SF).collect()
    turns = common.read(spark, SF, "conversations").collect()
    known = {(r.conv_id, r.turn) for r in turns}
    want = {(r.conv_id, r.turn): (r.conv_id, r.turn + 1) in known and next(x.role for x in turns if (x.conv_id, x.turn) == (r.conv_id, r.turn + 1)) != "assistant" for r in turns if r.role == "assistant"}
    assert {(r.conv_id, r.turn): r.status == "linked" for r in got if r.status != "invalid"} == {k: v for k, v in want.items() if k in {(r.conv_id, r.turn) for r in got if r.status != "invalid"}}
    assert {(r.conv_id, r.turn) for r in got} == set(want)


def test_op3(spark, texts):
    got = {r.doc_id: r for r in queries.queries()["op3_toxicity"](spark, SF).collect()}
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(model.score(t), abs=1e-9) and got[i].predicted == (got[i].score >= 0.5)
        assert got[i].offending == [n for n, _, _ in model.offending(t)] and got[i].n_offending == len(got[i].offending)
    rows = toxicity.offending_sentences(docs, model).collect()
    assert sorted((r.doc_id, r.sentence) for r in rows) == sorted((i, n) for i, r in got.items() for n in r.offending)
    assert all(r.words == " ".join(toxicity.sentences(texts[r.doc_id])[r.sentence]) and r.probability >= 0.5 for r in rows)


def test_score_takes_the_place_of_columns_of_its_name(spark):
    model = toxicity.Model({"fool$": 9.0}, -4.0)
    df = spark.createDataFrame([(1, "You fool. Fine day.", 7.0, "x"), (2, None, 8.0, "y")], "doc_id long, text string, score double, offending string")
    got = toxicity.score_column(df, model)
    assert got.columns == ["doc_id", "text", "score", "offending"]
    assert {r.doc_id: (r.score > 0.5, r.offending) for r in got.collect()} == {1: (True, [0]), 2: (False, [])}


def test_op5(spark, texts):
    got = {r.doc_id: r for r in queries.queries()["op5_fingerprints"](spark, SF).collect()}
    order = sorted(texts)
    errors = []

    def weights(t):
        return {w: 1 + math.log(n) for w, n in Counter(t.lower().split()).items()}

    def true(a, b):
        a, b = weights(a), weights(b)
        whole = sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
        return sum(min(a[w], b[w]) for w in a.keys() & b.keys()) / whole if whole else 1.0

    for i, following in zip(order, order[1:] + order[:1]):
        t, r = texts[i], got[i]
        own = fingerprints.edited(t, texts[following])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(own.encode()).hexdigest())
        assert len(own) == len(t) - len(t) // 2 + min(len(t) // 2, len(texts[following]))
        errors += [r.near_edited - true(t, own), r.near_next - true(t, texts[following])]
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.2
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.06


def test_op5_parts(spark, monkeypatch, texts):
    """A text of more terms than a part, and ranges of many sizes, give the same fingerprints."""
    df = spark.createDataFrame([(i, " ".join(f"t{i % 3}x{j}" for j in range(40 * i))) for i in range(12)], "doc_id long, text string")
    want = sorted(map(tuple, fingerprints.with_neighbours(df, parts=2).collect()))
    assert sorted(map(tuple, fingerprints.with_neighbours(df, parts=7).collect())) == want
    one, other = fingerprints.Sampler(), fingerprints.Sampler()
    text = " ".join(f"w{j % 900}" for j in range(2000))
    whole = one.fingerprint(text)
    monkeypatch.setattr(fingerprints, "CACHE", 100)
    assert other.fingerprint(text) == whole


def windows_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = common_words(t)
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            key = tuple(words[at : at + 20])
            if key in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def common_words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_op9(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.queries()["op9_substrings"](spark, SF).collect()}
    want = windows_removed(texts.items())
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in want.items()}
    assert sum(m for _, m, _ in want.values()) > 100


def test_substrings_on_overlapping_repeats(spark):
    """Few words, so that runs of 5 and 10 repeat by themselves, and passages that overlap, repeat within a text and reach its ends."""
    r = random.Random(4)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(15, 45))] for _ in range(10)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            p, a = r.choice(passages), r.randint(0, 5)
            words += [r.choice("abcdefgh") for _ in range(r.randint(0, 9))] + p[a : len(p) - r.randint(0, 5)] * r.choice([1, 1, 2])
        rows.append((i, "\n ".join(words)))
    rows += [(100, None), (101, ""), (102, "x y " * 50), (103, " ".join("abcdefghijklmnopqrs")), (104, "é ü " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.dedup_substrings(df).collect()} == windows_removed(rows)


def test_substrings_end_where_no_candidate_survives(spark, monkeypatch):
    levels = []
    own = substrings._level
    monkeypatch.setattr(substrings, "_level", lambda n: levels.append(n) or own(n))
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(4)], "doc_id long, text string")
    assert all(x.n_removed == 0 for x in substrings.dedup_substrings(df).collect()) and levels == [5]
    levels.clear()
    half = " ".join(f"s{j}" for j in range(7))  # repeats at 5 words, not at 10
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9)) + " " + half + " " + " ".join(f"v{i}x{j}" for j in range(9))) for i in range(40)], "doc_id long, text string")
    assert all(x.n_removed == 0 for x in substrings.dedup_substrings(df).collect()) and levels in ([5], [5, 10])


def test_op7_recall(spark):
    """Pairs of lines with a similarity of 0.80 to 0.86, of several lengths: nearly all are found."""
    r = random.Random(3)
    rows = []
    for n in [20, 45, 150, 400] * 100:
        x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        y = x + "".join(r.choice("0123456789") for _ in range((n - 7) // 5))
        a, b = lines.shingles(x), lines.shingles(y)
        assert 0.8 <= len(a & b) / len(a | b) <= 0.87
        rows += [(len(rows), x), (len(rows) + 1, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.removed_lines(df).where("n_removed = 1").count() >= 0.98 * 400


def test_small_blocks_and_tiles(spark, monkeypatch):
    """Blocks and tiles smaller than the groups give what large ones give."""
    from tessera.llm import near, simhash

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(3)]
    texts = []
    for i in range(90):
        own = list(base[i % 3])
        for at in r.sample(range(120), r.choice([0, 1, 2, 4])):
            own[at] = word()
        texts.append((i, " ".join(own), 1.0))
    df = spark.createDataFrame(texts, "doc_id long, text string, removed double")
    whole = sorted(x.doc_id for x in near.keep_first(df).collect())
    linked = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(lines, "BLOCK", 5)
    assert sorted(x.doc_id for x in near.keep_first(df).collect()) == whole
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == linked
    assert lines.dedup_lines(df).columns == df.columns
    assert len(whole) < 90


def test_long_texts(spark):
    """A text of some megabytes beside short ones: parts and ranges add up."""
    import public_tokenizers

    from tessera.llm import simhash, token_counts

    long = " ".join(f"w{j * 7919 % 50021}" for j in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(df).collect()}
    assert got[1][0] == 400_000 and got[3] == (400_000, 400_000) and got[2] == (1, 0) and got[4] == (0, 0)
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert found[3].component_id == 1 and found[4].component_id == 4
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()}
    assert counted[1] == counted[3] > 400_000 and counted[4] == 0
    assert token_counts.Counter(path).split and not token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json")).split


def test_odd_arguments(spark):
    import json

    deep = "[" * 100_000 + "]" * 100_000
    odd = {"a": '{"x": "\\ud800"}', "b": '{"x": 1e400}', "c": "NaN", "d": deep, "e": '{"x": 2.0}', "f": '{"\\udfff": 1}', "g": "null"}
    text = json.dumps({"tool_calls": [{"id": k, "name": "f", "arguments": v} for k, v in odd.items()]})
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    schema = {"f": {"type": ["object", "null"], "properties": {"x": {"type": ["integer", "string"]}}, "additionalProperties": False}}
    got = {r.call_id: r for r in tool_calls.linked_calls(df, schema).collect()}
    assert {k for k in odd if got[k].status == "invalid"} == {"b", "c", "d", "f"}
    assert all(isinstance(json.loads(r.json), dict) for r in got.values())
    assert tool_calls.errors(1, {"type": "no such type"}) and not tool_calls.errors(1, True) and tool_calls.errors(1, False)


def test_random_calls_in_order(spark):
    """Random needs with cycles, duplicates and missing calls: marks equal brute force, and every call outside a cycle comes after those it needs."""
    import json

    r = random.Random(6)
    rows, want = [], {}
    for conv in range(12):
        n = r.randint(1, 14)
        after = {f"c{i}": [f"c{r.randrange(n + 2)}" for _ in range(r.choice([0, 0, 1, 2]))] for i in range(n)}
        names = sorted(after, key=lambda _: r.random())
        for turn, i in enumerate(names):
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": "{}", "after": after[i]}]})))
        reach = {i: {x for x in after[i] if x in after} for i in after}
        for _ in after:
            reach = {i: s.union(*(reach[x] for x in s)) for i, s in reach.items()}
        for i in after:
            want[conv, i] = (i in reach[i], any(x not in after for x in after[i]), {x for x in after[i] if x in after and x not in reach[x] | set() or (x in after and i not in reach[i])} - {i})
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(x.conv_id, x.call_id): x for x in tool_calls.linked_calls(df, {"f": {"type": "object"}}).collect()}
    assert set(got) == set(want)
    for key, (cycle, missing, needs) in want.items():
        assert ("cycle" in got[key].problems, "a call that it needs is missing" in got[key].problems) == (cycle, missing)
        if not cycle:
            assert all(got[key[0], x].position < got[key].position for x in needs)
    for conv in range(12):
        own = sorted(x.position for (c, _), x in got.items() if c == conv)
        assert own == list(range(len(own)))
