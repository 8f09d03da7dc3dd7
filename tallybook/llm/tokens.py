"""Byte-level BPE ids as the tokenizers library gives them, at the speed of tiktoken."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Texts from this length with runs that exhaust a backtracking pattern engine take the other library.
_LONG_TEXT, _LONG_RUN = 500_000, re.compile(r"\s{100000}|\S{200000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _byte_of_char() -> dict[str, int]:
    """Printable Latin bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes with one vocabulary file of a byte-level BPE without added prefix space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        char = _byte_of_char()
        vocabulary = {bytes(char[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.special = special
        self.fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=special
        )
        size = 1 + max([*vocabulary.values(), *special.values()])
        self.lengths = np.zeros(size, np.int64)
        self.ends_sentence = np.zeros(size, bool)
        for token, i in [*vocabulary.items(), *((s.encode(), i) for s, i in special.items())]:
            self.lengths[i] = len(token)
            self.ends_sentence[i] = token.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if len(text) > _LONG_TEXT and _LONG_RUN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def text(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per Python worker and file."""
    return Coder(path)
