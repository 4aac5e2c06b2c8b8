"""Byte-level BPE ids of whole texts, from a public tokenizer file.

The ids are those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``; the strings of
special tokens in a text get their own ids, or with ``plain_special`` those of ordinary text.  Texts are cut where that
tokenizer's own word splitting always cuts, and each different chunk is encoded once and remembered; tests hold the
result against the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# Fixed value: the splitting pattern that byte-level BPE files of this kind imply (their "use_regex" setting).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The tokenizer keeps a run of white space together but for its last character, which a space lends to the next word.
CHUNKS = re.compile(r"\s+(?!\S)| ?\S+|\s")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for Python's re, not for the tokenizer


def byte_symbols() -> dict[str, int]:
    """Printable symbol of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def even(text: str) -> bool:
    """Whether every space of a text stands alone between two words."""
    return (text != "" and text.replace("\n", "").isprintable() and "  " not in text and " \n" not in text
            and "\n " not in text and text[0] != " " and text[-1] != " ")


class Encoder(dict):
    """Chunk (without its leading space) -> little-endian uint32 ids; holds ``most`` chunks, then starts anew."""

    def __init__(self, path: str, most: int = 400_000, plain_special: bool = False):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", ())}
        self.special = {} if plain_special else special
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def plain(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[chunk] = self.plain(" " + chunk)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes."""
        if text and any(s in text for s in self.special):
            return b"".join([self.special.get(part) or self.ordinary(part) for part in self.cuts.split(text)])
        return self.ordinary(text)

    def after_space(self, text: str) -> bytes:
        """Ids of a space and the text."""
        if even(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, text.split(" ")))
        return self.encode(" " + text)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if even(text):
            # every space stands alone before a word, so the tokenizer cuts before each of them
            first, *rest = text.split(" ")
            return self.plain(first) + b"".join(map(self.__getitem__, rest))
        if SEPARATORS.search(text):
            return self.plain(text)
        return b"".join([self[c[1:]] if len(c) > 1 and c[0] == " " and not c[1].isspace() else self.plain(c)
                         for c in CHUNKS.findall(text)])
