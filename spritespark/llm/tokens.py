"""Whole texts to ids of a public byte-level BPE, in Arrow batches inside tasks.

The ids are those that the ``tokenizers`` library gives for byte_bpe_50k.json with add_special_tokens=False
(the tests compare them). The same vocabulary's rank file is several times cheaper to apply, so it encodes every text
but the few that hold the special token's string, or a run of one kind so long that the rank file's pattern matcher
gives up on it: these the JSON file's tokenizer encodes.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np

from spritespark.llm.common import vocabulary_path

SPECIAL = "<|endoftext|>"
VOCABULARY = 50_257


@cache
def _ranks(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str | None, end: int | None = None, name: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a text (null: empty) as uint32, followed by ``end`` where given."""
    text, ids = text or "", None
    if SPECIAL not in text:
        try:
            ids = _ranks(vocabulary_path(f"{name}.tiktoken")).encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the matcher's stack is exhausted
                raise
    if ids is None:
        ids = _json(vocabulary_path(f"{name}.json")).encode(text, add_special_tokens=False).ids
    if end is not None:
        ids.append(end)
    return np.array(ids, np.uint32)
