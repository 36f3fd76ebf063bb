"""Nulls, empty and repeated rows, empty tables and clashing extra columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import decontaminate, fingerprints, lines, mixing, simhash, substrings, token_counts, tool_calls, toxicity, warc

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, LONG, "a"), (2, None, None), (3, "", "a"), (4, LONG, "b"), (4, LONG, "b"), (5, "x " + LONG + " y\nx y z", "a"), (6, " \t\n", None), (None, "alone in here", "b"), (7, "One, Two", "b"), (7, "three", "b")]
SCHEMA = "doc_id long, text string, source string, size long, uid long, pos int, w string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 9, 9, 9, "9", "en") for i, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_token_counts(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(1, "A<|endoftext|>b it's ΑΣ Σ\u00a0x\u0301 日本 12345 <|startoftext|>\r\n"), (2, None), (3, "don't stop…\u2003ok"), (4, "é" * 3000)]
    df = docs.sparkSession.createDataFrame(odd, "doc_id long, text string")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, path).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd}
    assert token_counts.token_counts(docs, path).count() == len(ROWS) and token_counts.token_counts(none, path).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
    assert mixing.mix_sources(none).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "same"), (2, "u", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha1 long")
    got = warc.read_records(warc.archive_pages(df, f"file://{tmp_path}/a"), payload=True).collect()
    assert len(got) == len(pages)
    for r in got:
        text = next(h for i, _, h in pages if i == r.page_id) or ""
        assert r.payload_bytes == len(text.encode()) and (r.record_type == "revisit" or r.payload == text.encode())
    assert sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in got), key=str) == sorted([(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)], key=str)
    assert warc.read_records(warc.archive_pages(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_fingerprints(docs, none):
    got = fingerprints.with_neighbours(docs, parts=3).collect()
    assert len(got) == len(ROWS)
    order = sorted(((i is not None, i or 0, t or "") for i, t, _ in ROWS))
    texts = [t for *_, t in order]
    want = sorted(hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1]))
    assert sorted(r.edited_sha256 for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (1, 4)}) == 1
    assert fingerprints.with_neighbours(none).count() == 0


def test_toxicity(docs, none):
    texts = ["you are a fool. really", "what a nice day. yes"] * 40
    model = toxicity.train(texts, [1, 0] * 40)
    assert model.score("oh you fool.") > 0.5 > model.score("nice day") and model.offending("Fine. you fool!")[0][0] == 1
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(docs, labels).columns == docs.columns
    assert toxicity.reject_toxic(none, labels.limit(0)).count() == 0
    assert zlib.crc32(b"1") % 5 >= 0


def test_simhash(docs, none):
    got = {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id in (1, 4)}
    assert got == {1}
    assert {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id in (2, 3, 6)} == {2}
    assert simhash.near_duplicates(none).count() == 0


def test_decontamination(docs, none):
    items = docs.sparkSession.createDataFrame([(1, LONG), (2, "two"), (3, None), (10, "!!")], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert sum(r.n_rows for r in got) == len(ROWS)
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in got if r.n_hit} == {(1, 60, ("1",)), (4, 60, ("1",)), (5, 60, ("1",)), (7, 1, ("2",))}
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert decontaminate.contamination(none, items.limit(0)).count() == 0


def test_lines(docs, none):
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in lines.removed_lines(docs).collect()}
    assert (1, 1, 0) in got and (4, 1, 1) in got and (2, 0, 0) in got
    assert lines.removed_lines(none).count() == 0


def test_line_bound():
    """The bound on bit maps never rules out a pair that is similar, and does rule out others."""
    r = random.Random(5)
    pairs = [("a", "a"), ("a", "b"), ("aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaa")]
    for n in [9, 20, 60, 200, 500, 4000] * 40:
        x = "".join(r.choice("abcdefgh é") for _ in range(n)).strip() or "x"
        y = list(x)
        for _ in range(r.randrange(max(2, n // 40))):
            y[r.randrange(len(y))] = r.choice("xyz")
        pairs.append((x, "".join(y)))
    x, y = zip(*pairs, strict=True)
    n = np.array([lines.count(a) + lines.count(b) for a, b in pairs])
    out = lines.apart(lines.maps(list(x)), lines.maps(list(y)), n)
    near = np.array([lines.similar(lines.shingles(a), lines.shingles(b)) for a, b in pairs])
    assert near.sum() > 40 and not (out & near).any() and out.sum() > 20


def test_substrings(docs, none):
    got = substrings.dedup_substrings(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id in (1, 2, 4, 5)} == {(1, 60, 0), (2, 0, 0), (4, 60, 60), (5, 65, 60)}
    assert substrings.dedup_substrings(none).count() == 0


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":"{\\"x\\": 1.0, \\"b\\": 2}","after":["b"]},{"id":"b","name":"f","arguments":"{\\"x\\":\\"s\\"}","after":[]}]}'
    rows = [(1, 0, "assistant", call), (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 2, "user", None), (1, 3, "tool", '{"tool_call_id":"z"}'), (None, None, None, "{bad")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"f": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]}}
    got = {r.call_id: r for r in tool_calls.linked_calls(df, schema).collect()}
    assert got["b"].position == 0 and got["a"].position == 1 and got["a"].status == "linked" and got["b"].status == "invalid"
    assert got["a"].json == '{"arguments":{"b":2,"x":1},"id":"a","name":"f","result":"ok"}'
    assert [r.call_id for r in tool_calls.orphans(df).collect()] == ["z"]
    assert tool_calls.linked_calls(df.limit(0), schema).count() == 0
