"""Token ids of texts under a byte-level BPE vocabulary file.

The ids are those that the ``tokenizers`` library gives for the same file;
``tiktoken`` computes them several times faster. Tests hold both equal.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.json"
END_OF_DOCUMENT = 50256


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + place): byte for place, byte in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary as an encoder; loaded once per worker process."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {token["content"]: token["id"] for token in spec["added_tokens"]}
    byte_of = _byte_of_symbol()
    ranks = {
        bytes(byte_of[symbol] for symbol in token): rank
        for token, rank in spec["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str, specials_as_text: bool = False) -> np.ndarray:
    """Ids of one text. A special token's string in the text gives its id, unless ``specials_as_text``."""
    coder = encoding(path)
    ids = coder.encode_ordinary(text) if specials_as_text else coder.encode(text, allowed_special="all")
    return np.array(ids, np.uint32)
