"""Byte-level BPE encoding in Arrow batches.

The vocabulary is ``byte_bpe_50k``.  The ids are those the ``tokenizers``
library gives for the .json file, with its default for special strings inside a
text (they become the special id).  The merges run in ``tiktoken`` over the same
vocabulary's ranks, which gives the same ids several times faster; the tests
hold the two against each other.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Longer texts are encoded in parts, so that one text never holds a large id list at once.
PART_CHARS = 1 << 16
#: Target of UTF-16 code units for one inner batch.
BATCH_CHARS = 1 << 20
#: Where a pre-token always ends: before one blank between two characters that aren't blank, and between
#: a letter or digit and a punctuation mark.  The special string holds no blank, and of these marks only "|" after a letter, left out here.
_SAFE = re.compile(r"\S(?= \S)|[^\W_](?=[!-/:-@\[-`{}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None):
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS)) as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries: the ids of the parts, joined, are the text's ids."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def arrays(enc, text: str) -> Iterator[np.ndarray]:
    """The ids of one text, part by part, as unsigned 32-bit integers."""
    for part in parts(text):
        yield enc.encode_to_numpy(part, allowed_special="all")


def encode(enc, text: str) -> np.ndarray:
    """All ids of one text: four bytes each, however long it is."""
    found = list(arrays(enc, text))
    return found[0] if len(found) == 1 else np.concatenate(found)


def length(enc, text: str) -> int:
    """The number of ids of one text, without keeping them."""
    return sum(map(len, arrays(enc, text)))
