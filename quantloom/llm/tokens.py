"""Byte-level BPE for the operators that count, encode or pack tokens: by rank files, and by the tokenizers library."""

from __future__ import annotations

import base64
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

DEFAULT_RANKS, DEFAULT_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Distinct pre-tokens whose ids a worker remembers.
MEMORY = 600_000


def ranks_path(name: str = DEFAULT_RANKS) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """One encoder for each rank file in a worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    """The pattern that splits text, its runs of letters, numbers and others possessive: a run of a class that ends an
    alternative is never given back, so matches are the same and found sooner."""
    return regex.compile(public_tokenizers.PATTERN.replace("}+|", "}++|").replace("]+|", "]++|"))


@lru_cache(maxsize=70_000)
def kind(c: str) -> str:
    """What the pattern takes a character for: L a letter, N a number, S white space, O any other; empty where versions of
    Unicode, and so implementations of the pattern, may differ: what is no white space, letter, number, mark, sign or
    punctuation of the basic plane, alike in version 3.2 and today's."""
    if c in " \t\n\x0b\x0c\r\xa0":
        return "S"
    if c < "\x80":
        return "L" if c.isalpha() else "N" if c.isdigit() else "O" if c.isprintable() else ""
    own, then = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    return {"L": "L", "N": "N", "Z": "S", "M": "O", "S": "O", "P": "O"}.get(own, "") if own == then and c <= "￿" else ""


def sure_boundary(left: str, right: str) -> bool:
    """Whether any reading of the pattern, from wherever it starts, ends a match between these two characters: a letter
    or number and what is none. (A match that holds the left one goes on to its last letter or number, and no further.)"""
    a, b = kind(left), kind(right)
    return a in ("L", "N") and bool(b) and a != b


def _class(wanted: str) -> str:
    """The characters of this kind as the inside of a character class; of any kind for an empty string."""
    spans, start = [], None
    for cp in range(0x10001):
        good = cp < 0x10000 and kind(chr(cp)) != "" and kind(chr(cp)) in (wanted or "LNSO")
        if good and start is None:
            start = cp
        elif not good and start is not None:
            spans.append((start, cp - 1))
            start = None
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans)


@lru_cache(maxsize=1)
def unsure() -> re.Pattern:
    """Characters whose kind implementations may see differently."""
    return re.compile(f"[^{_class('')}]")


@lru_cache(maxsize=1)
def sure_pattern() -> re.Pattern:
    """The pattern for texts without unsure characters, its classes spelled out: the standard library's matcher looks
    characters up in a table, and needs less than half the time."""
    own = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[{_class('O')}]")
    for name, inside in ((r"\p{L}", _class("L")), (r"\p{N}", _class("N"))):
        own = own.replace(name, f"[{inside}]")
    own = own.replace("]+|", "]++|")  # runs before an alternative's end are never given back
    white = _class("S")
    kind.cache_clear()
    return re.compile(own.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]"))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others follow
    from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)}


class WordIds(dict):
    """Ids by the tokenizers library, which looks at each distinct pre-token once: the library takes a text apart by the
    same pattern and encodes each part by itself. Texts with characters that implementations of the pattern may see
    differently, and such that spell a special token, go to the library whole. As a dict: ids of pre-tokens as
    little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        parts = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        ids = struct.pack(f"<{len(parts)}I", *[p.id for p in parts])
        if len(self) < MEMORY:
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        odd, split, get = unsure().search, sure_pattern().findall, self.__getitem__
        whole = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [whole(t) if odd(t) or any(s in t for s in self.special) else b"".join(map(get, split(t))) for t in texts]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
