"""Exact, fast encoding with a public BPE tokenizer: chunks of a text that cannot influence each other are cached.

``WordEncoder`` cuts a text where the tokenizer's own pre-tokenizer always cuts, encodes each distinct chunk once with
the tokenizers library and joins the little-endian ids. The ids are those of ``Tokenizer.encode(text,
add_special_tokens=False)``; a text that holds an added token's string is given to the library whole. The cache has two
generations of at most about ``limit`` chunks of at most ``LONGEST`` characters: chunks in use move to the younger, the
older is dropped when that is full. So a worker's memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from string import punctuation

LIMIT = 500_000
LONGEST = 64
#: Unicode white space; unlike ``str.split``, without the separators U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The visible character that byte-level models use for each byte: itself, or for others U+0100 onwards in their order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
SPACE_CHAR = BYTE_CHARS[32]
_SPACES = re.compile(f"[{SPACE}]+")
_RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: What a text must not hold to be cut by single spaces and newlines: white space side by side, other white space, the mark of cuts.
_ASCII_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0")
_OTHER_ODD = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def drop_space(text: str) -> list[str]:
    """Chunks for tokenizers that drop white space: its maximal runs separate them."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def keep_space(text: str) -> list[str]:
    """Chunks for byte-level tokenizers: a run of other characters with the one space before it, or white space.

    Texts whose words are parted by one space or newline each are cut by replacing those, which is faster; chunks may be empty there.
    """
    for odd in _ASCII_ODD:
        if odd in text:
            return _RUNS.findall(text)
    if not text.isascii():
        for odd in _OTHER_ODD:
            if odd in text:
                return _RUNS.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class _Cache(dict):
    """Ids by chunk; what is missing comes from the older generation or is learned."""

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.learn, self.older = learn, older

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.learn(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found


class WordEncoder:
    """Encodes whole texts; ids are ``width`` bytes each, little-endian."""

    def __init__(self, path: str, lowers: bool, width: int = 4, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.lowers, self.width, self.limit = lowers, width, limit
        self.chunks = drop_space if lowers else keep_space
        self.ids = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Cache(self._learn, {})

    def encode(self, text: str) -> bytes:
        """Ids of the whole text."""
        if any(x in text for x in self.added):
            return self._plain(text)
        if len(self.cache) > self.limit:
            young, self.cache.older = self.cache, {}
            self.cache = _Cache(self._learn, young)
        return b"".join(map(self.cache.__getitem__, self.chunks(text)))

    def _plain(self, text: str) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't cached.

        A run of ASCII punctuation after a Latin letter is always cut off. Chunks of Latin letters are left whole by
        normalisation and cutting, so the model gets them directly; all others go through the whole tokenizer.
        """
        if not chunk:
            return b""
        lowers, ids = self.lowers, self.ids
        stem = chunk.rstrip(punctuation)
        if len(stem) < len(chunk) and stem[-1:] < "\u0250" and stem[-1:].isalpha():
            return self.cache[stem] + self.cache[chunk[len(stem) :]]
        word = chunk[1:] if chunk[0] == " " else chunk
        if not word.isalpha():
            return self._plain(chunk)
        if word.isascii():
            low = word.lower() if lowers else word
            if low != word:
                return self.cache[low]
        elif max(word) < "\u0250" and "\u0130" not in word:
            word = (word.lower() if lowers else word).encode().decode("latin-1").translate(BYTE_CHARS)
        else:
            return self._plain(chunk)
        if chunk[0] == " ":
            word = SPACE_CHAR + word
        return b"".join([ids[t.id] for t in self.tokenize(word)])


@lru_cache(maxsize=4)
def encoder(path: str, lowers: bool, width: int = 4, limit: int = LIMIT) -> WordEncoder:
    """One encoder for each tokenizer file in a worker process."""
    return WordEncoder(path, lowers, width, limit)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> int:
    """Number of ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
