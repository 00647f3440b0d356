"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.plans.tables import spread

VOCABULARY = os.environ.get("SILTSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern this vocabulary was made with (fixed value): contractions, words, numbers, signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Text beyond this many characters is encoded in parts cut at line ends or blanks, which bounds the memory of a call.
PART_CHARS = 1 << 20


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> list[str]:
    """``text`` in parts of at most ``PART_CHARS``, cut before a blank or line break where there is one."""
    out = []
    while len(text) > PART_CHARS:
        at = max(text.rfind("\n", 1, PART_CHARS), text.rfind(" ", 1, PART_CHARS))
        at = at if at > 0 else PART_CHARS
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return sum(len(encoder(vocabulary).encode_ordinary(p)) for p in parts(text or ""))


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have 0 tokens."""

    def measure(batches):
        for b in batches:
            n = [count(t, vocabulary) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(measure, "doc_id long, n_tokens long")
