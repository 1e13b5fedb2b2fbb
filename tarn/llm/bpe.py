"""Token ids of a public byte-level BPE vocabulary.

The vocabulary file is read from where ``public_tokenizers`` keeps it; its ids
are at the same time the merge ranks, so tiktoken's BPE core gives the ids of the
tokenizers library as it is by default with ``add_special_tokens=False``, in a
quarter of its time. As there, the string of a special token in a text is that
token. The tests compare both on whole documents and on random texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k.json"):
    """The encoder of a vocabulary file, made once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        said = json.load(f)
    alphabet = byte_alphabet()
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(texts: list[str], end_id: int, name: str = "byte_bpe_50k.json") -> Iterator[np.ndarray]:
    """For each text its ids and the end id, as unsigned 32-bit numbers."""
    encode, special = encoder(name).encode_to_numpy, encoder(name).special_tokens_set
    for text in texts:
        yield np.append(encode(text, allowed_special=special, disallowed_special=()), np.uint32(end_id)).astype("<u4", copy=False)
