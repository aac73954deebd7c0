"""Ids and pre-tokens of texts as a ``tokenizers`` file gives them.

Most texts hold only ASCII and Latin letters. For those, a file's split pattern can be written
with plain character classes, and equal pre-tokens always get equal ids, so every pre-token
is encoded by the library once per process and looked up afterwards. All other texts,
those with a marker of special tokens included, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

#: Characters that every Unicode version and regex dialect puts into the same classes; NFC leaves them as they are.
_LETTERS = "A-Za-zÀ-ÖØ-öø-į"
_SAFE = re.compile(f"[\t\n\r\x20-\x7e¡-©«®°±´¶-¸»¿–—‘-„…€{_LETTERS}]*")

#: Pre-tokens kept per process; beyond it the cache starts anew.
CACHE_SIZE = 1_000_000
#: A space beside other white space.
_WIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


def _plain(pattern: str) -> re.Pattern:
    """The pattern in plain character classes; a class's own brackets go."""
    inside = {r"\p{L}": _LETTERS, r"\p{N}": "0-9", r"\s": r"\t\n\r\x20", r"\S": r"\S"}
    out, depth, i = [], False, 0
    while i < len(pattern):
        unit = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, i)), pattern[i])
        i += len(unit)
        if unit == "[":
            depth = True
        elif unit == "]":
            depth = False
        out.append((inside[unit] if depth or unit == r"\S" else f"[{inside[unit]}]") if unit in inside else unit)
    return re.compile("".join(out))


class _Cache(dict):
    """Ids by chunk of text; a new chunk is split and its pre-tokens are encoded by the library's model."""

    def __init__(self, split, model, spelling, kind, start=""):
        self.split, self.model, self.spelling, self.kind, self.start = split, model, spelling, kind, start

    def __missing__(self, chunk: str) -> bytes:
        out = []
        for piece in self.split(self.start + chunk):
            out += [t.id for t in self.model.tokenize(piece.translate(self.spelling))]
        ids = self[chunk] = struct.pack(f"<{len(out)}{self.kind}", *out)
        return ids


class Encoder:
    """One tokenizers file. ids(): little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.markers = [t["content"] for t in config["added_tokens"]]
        kinds = [n["type"] for n in config["normalizer"]["normalizers"]] if config["normalizer"] else []
        split = config["pre_tokenizer"]
        self.lower = kinds == ["NFC", "Replace", "Lowercase"]
        self.pattern = None
        if split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not kinds:
            # Fixed value: the pattern that the byte-level pre-tokenizer is defined by.
            self.pattern = _plain(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        elif split["type"] == "Sequence" and [p["type"] for p in split["pretokenizers"]] == ["Split", "ByteLevel"] and self.lower:
            first, second = split["pretokenizers"]
            if first["behavior"] == "Removed" and first["invert"] and not second["use_regex"] and not second["add_prefix_space"]:
                self.pattern = _plain(first["pattern"]["Regex"])
        if self.pattern is not None:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            spelling = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x2030) if _SAFE.fullmatch(chr(c))}
            make = lambda start: _Cache(self.pattern.findall, self.library.model, spelling, "H" if self.width == 2 else "I", start)
            self._first, self._next = make(""), make(" ")

    def safe(self, text: str) -> bool:
        return self.pattern is not None and _SAFE.fullmatch(text) is not None and not any(m in text for m in self.markers)

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens, or None for a text that only the library can split."""
        return self.pattern.findall(text.lower() if self.lower else text) if self.safe(text) else None

    def encode(self, text: str) -> bytes:
        """The library's own ids of a whole text."""
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def spell(self, pieces: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        model, spelling = self.library.model, self._first.spelling
        return [len(model.tokenize(p.translate(spelling))) for p in pieces]

    def ids(self, text: str) -> bytes:
        if not self.safe(text):
            return self.encode(text)
        for cache in (self._first, self._next):
            if len(cache) > CACHE_SIZE:
                cache.clear()
        if self.lower:  # white space is dropped, and no pre-token spans it
            return b"".join(map(self._first.__getitem__, text.lower().split()))
        if any(gap in text for gap in _WIDE):
            return b"".join(map(self._first.__getitem__, self.pattern.findall(text)))
        # A lone space always starts a pre-token, so what follows it can be encoded by itself.
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._next.__getitem__, rest))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
