"""Token ids of whole texts, as the library ``tokenizers`` gives them for a tokenizer file.

A byte-level BPE file whose merge order is its id order is the same vocabulary as a table of
ranks, which ``tiktoken`` encodes several times faster to the same ids; other files, and
texts that hold one of the file's special tokens, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how a byte-level tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 for itself, other bytes from 256 up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """The file as a table of ranks, or None if it isn't one."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout")
    level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not (plain and level):
        return None
    vocab = model["vocab"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(vocab.get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    special, to_byte = {t["content"] for t in spec["added_tokens"]}, byte_of_character()
    ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``ids(texts)``: each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = ranked(path)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> bytes:
        if self.ranks is not None and not any(s in text for s in self.special):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    return Encoder(path)
