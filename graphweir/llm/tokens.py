"""Token ids of whole texts by a public tokenizer, encoded word by word.

The tokenizer splits a text into words by a fixed pattern before it merges anything, so a
text's ids are its words' ids in order.  Words repeat, so each is encoded once by the
library and kept in a bounded cache.  Texts outside Latin-1, and texts that spell special
tokens, go to the library whole: there the library's own Unicode tables decide.
"""

from __future__ import annotations

import os
import re

import numpy as np

from graphweir.llm.caches import kept

#: The words of the normalised (lower-cased) text, for characters below U+0100.  Fixed by the tokenizer's file.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
BLANKS = "\t-\r \x85\xa0"
WORD = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{BLANKS}{LETTERS}{NUMBERS}]+")
#: What the fast way knows about: a tokenizer with this split and no others.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_encoder(path: str | None = None) -> Encoder:
    """This process's encoder: what one task has learned serves the next."""
    path = path or default_path()
    return kept(("encoder", path), lambda: Encoder(path))


class Encoder:
    """Encodes texts to little-endian unsigned 16- or 32-bit ids."""

    def __init__(self, path: str | None = None, cached_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.by_word = KNOWN_SPLIT in str(self.tokenizer.to_str()).encode().decode("unicode_escape", "ignore")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached_words = cached_words
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        fresh = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(fresh) > self.cached_words:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        merge, kind = self.tokenizer.model.tokenize, self.dtype
        for w in fresh:  # the library's merges, without its normalising and splitting, which are done
            spelled = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_BYTES)
            self.known[w] = np.array([t.id for t in merge(spelled)], kind).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        words = WORD.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.known.__getitem__, words))
