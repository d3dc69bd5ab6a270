"""Token ids of whole texts by a public tokenizer file, with a bounded memo of words.

The word tokenizer drops white space and never merges across it, so the ids of a text are those of its words one
after another. A word's ids are kept once made; a word of plain letters and closing ASCII punctuation is made of
the two parts' ids, which recur far more often than the word. Everything else goes to the tokenizer as it is.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Fixed pattern: Latin letters whose lower case and normal form are single letters, then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-^`{-~]*)\Z")


class _Memo(dict):
    """Ids by key, made where missing. Holds at most ``most`` keys in two generations: those in use outlast the rest.

    Keys longer than ``longest`` are made anew each time, so a few very long words cannot fill the memory.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, max(1, most // 2), longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.half:
            self.old = self.copy()
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """``ids(text)`` as little-endian unsigned 32-bit bytes; holds at most ``most`` words and as many parts."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        # a part is a single piece for the merge model, which takes bytes as the printable characters standing for them
        bytes_as = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [c for c in map(chr, range(0x21, 0x100)) if not c.isspace()]
        printable = {ord(c): "".join(x for x, _ in bytes_as.pre_tokenize_str(c)) for c in plain}
        merge = tokenizer.model.tokenize

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def part(text: str) -> bytes:
            return packed([t.id for t in merge(text.translate(printable))]) if text else b""

        parts = _Memo(part, most)

        def word(key: bytes) -> bytes:
            text = key.decode()
            found = _PLAIN.match(text)
            if found:
                return parts[found[1].lower()] + parts[found[2]]
            return packed(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

        self.words = _Memo(word, most)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, (t or "").encode().split())) for t in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so the memo lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def as_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")
