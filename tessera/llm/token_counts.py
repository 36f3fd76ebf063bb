"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at ASCII white space where the tokenizer drops it and no token, merge or special string spans it, so the counts of its pieces add up to
the text's own; a tokenizer for which that isn't shown (`splits_at_space`) gets whole texts, in the same batches by bytes. Pieces are encoded in batches bounded by bytes, each distinct piece once for as long as it stays in a bounded cache.
Null counts as the empty text, which has no tokens. Repeated rows keep a row each; there is no shuffle.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of text in a batch, bytes of new pieces in a call of the tokenizer, and pieces in each of the two generations of the cache.
BATCH_BYTES, CALL_BYTES, CACHE = 1 << 20, 1 << 20, 150_000


def splits_at_space(tokenizer) -> bool:
    """Whether texts may be split at ASCII white space: the first pre-tokenizer drops it, no normalizer or post-processor looks across it, and no added token holds any."""
    spec = json.loads(tokenizer.to_str())
    first = spec.get("pre_tokenizer") or {}
    while first.get("type") == "Sequence":
        first = (first.get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", ".")
    if first.get("type") == "Split" and first.get("behavior") == "Removed":
        # What stays are matches: none may hold a space once its classes that exclude white space are set aside. Without invert, matches go: they must be the space.
        rest = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)
        drops = not re.search(r"\s|\\[sWDPvhRX]|\[\^|\.", rest) if first.get("invert") else pattern in (r"\s+", r"\s")
    else:
        drops = first.get("type") in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit")

    def local(step) -> bool:
        if step is None or step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer", "Nmt"):
            return True
        if step["type"] == "Replace":
            return step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        return step["type"] == "Sequence" and all(map(local, step["normalizers"]))

    added = spec.get("added_tokens") or []
    plain = not any(set(x["content"]) & set(" \t\n\v\f\r") or x.get("lstrip") or x.get("rstrip") for x in added)
    return bool(drops and local(spec.get("normalizer")) and plain)


class Counter:
    """Counts of white-space-separated pieces under a tokenizers file, with a two-generation cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = splits_at_space(self.tokenizer)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        at = 0
        while at < len(pieces):
            to, n = at, 0
            while to < len(pieces) and (to == at or n + len(pieces[to]) <= CALL_BYTES):
                n += len(pieces[to])
                to += 1
            got = encode([x.decode() for x in pieces[at:to]], add_special_tokens=False)
            self.young.update(zip(pieces[at:to], map(len, got), strict=True))
            at = to

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.split:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            return [len(x) for x in encode([x.decode() for x in texts], add_special_tokens=False)]
        split = [x.split() for x in texts]  # bytes.split: exactly the ASCII white space
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = set(chain.from_iterable(split)).difference(self.young)
        again = new.intersection(self.old)
        self.young.update((x, self.old[x]) for x in again)
        self._learn(sorted(new - again, key=len))
        get = self.young.__getitem__
        return [sum(map(get, x)) for x in split]


@functools.cache
def shared_counter(path: str) -> Counter:
    """A worker's counter for a file, which keeps its cache from task to task."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row's whole text, under the tokenizers file at path (present on every machine)."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        counter = shared_counter(path)
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            tokens: list[int] = []
            for at, to in common.groups(offsets, BATCH_BYTES):
                tokens += counter.counts([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(at, to)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
