"""Byte-level BPE vocabulary files and the splitting of texts before the merges.

A vocabulary file is a parameter: a path that every executor can read. It is read once per
worker process.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import regex

# Fixed value: the pattern that byte-level vocabularies of this kind split text by.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Entries a worker keeps of one kind, twice: those used lately and those before them. About 60 MB in all.
CACHE_ROWS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter a vocabulary file writes for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """``tokens`` by id as bytes, ``ids`` by bytes, ``special`` ids by text.

    ``merges`` has the rank of a pair of ids under ``left << 20 | right``, ``merged`` the id by rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letter = byte_letters()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        vocab = {k: v for k, v in data["model"]["vocab"].items() if k not in self.special}
        self.ids = {bytes(letter[c] for c in k): v for k, v in vocab.items()}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def sections(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(text, None) between special strings and (string, its id) for each of them."""
        at = 0
        if self.cut is not None and any(s in text for s in self.special):
            for m in self.cut.finditer(text):
                if m.start() > at:
                    yield text[at:m.start()], None
                yield m.group(), self.special[m.group()]
                at = m.end()
        if at < len(text):
            yield text[at:], None


class Table(dict):
    """Values computed on first use, in two generations: when the young one is full, it takes the place of the old one.

    Frequent keys come back from the old generation, rare ones go, and memory stays bounded whatever the texts hold.
    """

    def __init__(self, compute: Callable, most: int = CACHE_ROWS):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Parts:
    """Values of whole texts from values of their parts.

    A single blank or line feed between two other characters always ends a pre-token, so a text
    may be cut there by plain string splitting, and each part is pre-tokenised on its own. Parts
    recur, so their values are kept. Texts with any other run of white space at such a place are
    given to the pattern as a whole. ``of_word`` gives the value of one pre-token, ``add`` joins
    the values of a list of them.
    """

    def __init__(self, of_word: Callable[[str], object], add: Callable[[list], object]):
        self.of_word, self.words, self.add = of_word, Table(of_word), add
        self.parts = Table(self._part)

    def _plain(self, text: str):
        return self.add([self.words[w] for w in PATTERN.findall(text)])

    def _part(self, part: str):
        if part.isalpha():
            return self.of_word(" " + part)
        if part[:-1].isalpha() and part[-1] in ".,;:!?)":  # a word and a mark after it are two pre-tokens
            return self.add([self.parts[part[:-1]], self.words[part[-1]]])
        body = part[1:] if part[:1] == "\n" else part
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return self._plain(part if body is not part else " " + part)

    def values(self, text: str) -> list | None:
        """Values of the parts after the first one, with the value of the first before them; None where cutting is unsafe."""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return None
        out = [self._plain(first)]
        out.extend(map(self.parts.__getitem__, rest))
        return None if None in out else out

    def of(self, text: str):
        values = self.values(text)
        return self._plain(text) if values is None else self.add(values)
