"""Token ids of whole texts by a byte-level BPE vocabulary in ``tokenizers`` format."""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np

#: How the public byte-level BPE vocabularies split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ("", "The thing's  here,\n\n and 12 of them...\tça öß 中文 🎉  ", "<a href='x'>`~|</a>\r\n" * 3)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBPE:
    """Ids exactly as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Texts go through ``tiktoken`` with the same vocabulary and merge order, which is some five
    times faster; a text with a special token's string goes through ``tokenizers``
    itself, and so do all texts if the two differ on the probes.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said.get("added_tokens", ())]
        self.fast = self._fast(said)

    def _fast(self, said: dict):
        try:
            import tiktoken
        except ImportError:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = {t: i for t, i in said["model"]["vocab"].items() if t not in self.special}
        try:
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            same = all(fast.encode_ordinary(p) == self.exact.encode(p, add_special_tokens=False).ids for p in _PROBES)
        except (KeyError, ValueError):
            return None
        return fast if same else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), np.uint32)

    def count(self, text: str) -> int:
        if self.fast is None or any(s in text for s in self.special):
            return len(self.exact.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


@cache
def tokenizer(path: str) -> ByteBPE:
    """One tokenizer per worker process."""
    return ByteBPE(path)
