"""Token ids of the public byte-level BPE vocabulary.

The vocabulary file (JSON of the ``tokenizers`` library) is a parameter.
Where its merges are in id order - true of the byte-level vocabularies used
here and checked on loading - the same merges run as ``tiktoken`` ranks,
which gives the same ids about five times faster; otherwise, and for a text
that engine refuses, ``tokenizers`` itself encodes.  Strings of special
tokens inside a text are ordinary text, or with ``special`` their single ids
as by default in ``tokenizers``; texts that hold one are encoded there.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, special: bool = False):
        self.path = path
        self.special = special
        self._slow = None
        self._fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._added = [t["content"] for t in spec.get("added_tokens", [])] if special else []
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        if in_order and plain:
            import public_tokenizers
            import tiktoken

            alphabet = _byte_alphabet()
            special = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
            self._fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = not self.special
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        ids = None
        if self._fast is not None and not any(t in text for t in self._added):
            try:
                ids = self._fast.encode_ordinary(text)
            except BaseException as e:  # the engine's panics on extreme runs are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self._encode_slow(text) if ids is None else ids, dtype="<u4")


@lru_cache(maxsize=2)
def byte_bpe(path: str, special: bool = False) -> ByteBpe:
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    return ByteBpe(path, special)
