"""Byte-level BPE ids equal to the tokenizers library's, several times faster on running text.

The same vocabulary's merge ranks are applied to the same pre-tokens by another library; a text that holds the string of a
special token goes to the tokenizers library itself, which gives such strings their own ids by default, and so does a text
with a run of more than `RUN` characters of white space or of none, on which the faster library would run out of stack or
take quadratic time. `tests/llm` holds this module against the library on ordinary, odd, random and very long texts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re

import public_tokenizers

#: Longest run of white space, or without any, that goes to the faster library.
RUN = 10_000
_LONG = re.compile(r"(?<!\s)\s{%d}|(?<!\S)\S{%d}" % (RUN + 1, RUN + 1))


def has_long_run(text: str) -> bool:
    """Whether RUN is passed. Most long texts are settled by their words' lengths, before the pattern is tried."""
    if len(text) <= RUN:
        return False
    words = text.split()
    lengths = list(map(len, words))
    # Every gap between words has a character, so a run of white space has at most what is over.
    if max(lengths, default=0) <= RUN and len(text) - sum(lengths) - len(words) < RUN:
        return False
    return _LONG.search(text) is not None


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        self._library = None
        with open(self.path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        ranks_path = self.path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @property
    def library(self):
        """The tokenizers library, loaded by the first text that needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or has_long_run(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for the file; workers are used again by later tasks."""
    key = path or public_tokenizers.path("byte_bpe_50k.json")
    if key not in _encoders:
        _encoders[key] = Encoder(key)
    return _encoders[key]


def version(path: str | None = None) -> str:
    """Digest of the tokenizer's file."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
