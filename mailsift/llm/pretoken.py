"""Pre-tokens of byte-level BPE vocabularies, and their ids.

A byte-level BPE tokenizer splits a text at its added tokens, splits the rest
into pre-tokens with one pattern, and merges inside each pre-token only. The
ids of a text are therefore the ids of its pre-tokens in order, and the ids of
one pre-token, taken from the tokenizers library, can be kept and used again.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: The split pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts below U+0250, letters and digits spelled out: a class of ranges
#: is matched several times faster than a property (tests compare them).
_LETTERS, _DIGITS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SMALL_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
SMALL = re.compile("[\u0000-\u001b\u0020-\u024f]*")

#: Ranges in which the ``regex`` module and the library agree on letters, digits
#: and white space. Other texts are split by the library.
SAME_CLASSES = re.compile("[\u0000-\u0557\u2000-\u208e\u20a0-\ua7cd]*")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is a
    printing Latin-1 character, else the next one from U+0100 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()

#: Entries that a cache holds; bounds a worker's memory. Further ones are made each time.
CACHE_ENTRIES = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """Splits texts into added tokens and pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        kind = str(self.tokenizer.pre_tokenizer)
        if self.tokenizer.normalizer is not None or not kind.startswith("ByteLevel(add_prefix_space=False"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space can be counted by pre-token")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_tokens = frozenset(added)
        self.added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        self.find_small = re.compile(SMALL_PATTERN).findall
        self.merge = self.tokenizer.model.tokenize

    def _plain(self, text: str) -> list[str]:
        if SMALL.fullmatch(text):
            return self.find_small(text)
        if SAME_CLASSES.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.added is None or self.added.search(text) is None:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.added.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-token (by the library's merges alone) or added token."""
        if piece in self.added_tokens:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS))]


class PieceIds(dict):
    """pre-token -> its ids as little-endian integers of ``width`` bytes."""

    # array writes the machine's order; Spark's machines are little-endian
    def __init__(self, splitter: Splitter, width: int):
        super().__init__()
        self.splitter, self.code = splitter, {2: "H", 4: "I"}[width]

    def __missing__(self, piece: str) -> bytes:
        got = array(self.code, self.splitter.ids(piece)).tobytes()
        if len(self) < CACHE_ENTRIES:
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.split(text)))


@functools.lru_cache(maxsize=2)
def piece_ids(path: str, width: int) -> PieceIds:
    """The cache of this worker process, which serves one task after the other."""
    return PieceIds(Splitter(path), width)
