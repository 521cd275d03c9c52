"""BPE encoding and decoding with a vocabulary file.

A word is a doubly linked list of symbols.  A priority queue holds the ranks of the
possible merges; the lowest rank, leftmost first, is taken out, entries whose symbols have
changed meanwhile are skipped as stale, and each merge queues the two pairs it creates, so
a word of n symbols costs n log n however long it is.  Decoding concatenates the strings
of the vocabulary.

Texts stay where they are: tasks encode their own rows and keep bounded caches of words and of pieces
between white space.  Every executor reads the vocabulary file by its path.

Defined cases: a missing text is an empty text; an empty text has no ids and decodes to
an empty text; repeated rows are encoded each; extra columns are kept by ``encoded`` and
may bear any name but the added ones, which are replaced; an empty table gives an empty
table.  The strings of special tokens in a text become their ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import whole

#: Unicode white space; controls 28 to 31 are not.
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: What ``str.split`` takes for white space besides.
CONTROLS = regex.compile(r"[\x1c-\x1f]")
#: Fixed value: the pieces in which the vocabulary's merges were counted.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces and words that a task remembers; beyond it the cache starts anew.
REMEMBERED = 1 << 18
#: Rows that a task encodes before it hands them on.
AT_ONCE = 500
_NO_PAIRS: dict[int, int] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def joined(parts: Iterable[tuple[bytes, str]]) -> tuple[bytes, str]:
    """Ids and decoded texts put together; what has no ids has no text."""
    parts = list(parts)
    return b"".join([a for a, _ in parts]), " ".join([b for _, b in parts if b])


class Remembered(dict):
    """Texts and what is made of them when they are first asked for."""

    def __init__(self, make: Callable[[str], tuple[bytes, str]]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> tuple[bytes, str]:
        made = self.make(text)
        if len(text) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = made
        return made


class Codec:
    """Vocabulary, merges and special tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        self.end = model["end_of_word_suffix"] or ""
        #: Ranks of the pairs of every left symbol, by the right one, and the symbol that each
        #: rank makes.
        self.ranks: list[dict[int, int]] = [_NO_PAIRS] * (max(self.ids.values()) + 1)
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            if self.ranks[self.ids[a]] is _NO_PAIRS:
                self.ranks[self.ids[a]] = {}
            self.ranks[self.ids[a]][self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        letters = byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        self.pieces = regex.compile(PIECE)
        self.spaces = regex.compile(SPACE)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache, self.words = Remembered(self.piece), Remembered(self.word)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges.

        A queue entry is the rank above the position of the left symbol.  ``at`` holds the rank
        of the pair that starts at each position now, -1 for none or a merged right symbol; an
        entry with another rank is stale.
        """
        n, ranks, made = len(symbols), self.ranks, self.made
        if n < 2:
            return symbols
        at = [ranks[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]
        shift = 14 if n < 1 << 14 else 32  # short words: entries of one machine digit
        queue = [r << shift | i for i, r in enumerate(at) if r >= 0]
        if not queue:
            return symbols
        heapify(queue)
        at.append(-1)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        while queue:
            top = heappop(queue)
            i, rank = top & low, top >> shift
            if at[i] != rank:
                continue
            new, j = made[rank], after[i]
            symbols[i], symbols[j], at[j] = new, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                at[i] = rank = ranks[new].get(symbols[k], -1)
                if rank >= 0:
                    heappush(queue, rank << shift | i)
            else:
                at[i] = -1
            if (h := before[i]) >= 0:
                at[h] = rank = ranks[symbols[h]].get(new, -1)
                if rank >= 0:
                    heappush(queue, rank << shift | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids, as little-endian 32-bit integers, and the decoded text of a word."""
        data, first = word.encode(), self.first
        symbols = [first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        symbols = self.merged(symbols)
        return array("I", symbols).tobytes(), " ".join([self.strings[i] for i in symbols])

    def plain(self, part: str) -> tuple[bytes, str]:
        """The same for text without special tokens and white space."""
        if part.isascii():
            part = part.lower()
            if part.isalpha():
                return self.words[part]
        else:
            part = unicodedata.normalize("NFC", part)
            # letter by letter: no letter's lower case depends on its neighbours
            part = part.lower() if "Σ" not in part else part.replace("Σ", "σ").lower()
        return joined([self.words[word] for word in self.pieces.findall(part)])

    def piece(self, piece: str) -> tuple[bytes, str]:
        """The same for a piece between white space."""
        if not self.marks or "<|" not in piece:
            return self.plain(piece)
        return joined([(array("I", [self.special[part]]).tobytes(), part) if part in self.special else self.plain(part)
                       for part in self.marks.split(piece)])

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text and the text they decode to."""
        # split() knows the same white space, but for four controls that belong to pieces
        parts = text.split() if not CONTROLS.search(text) else [p for p in self.spaces.split(text) if p]
        return joined(map(self.cache.__getitem__, parts))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def sliced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        for begin in range(0, len(part), AT_ONCE):
            yield part.iloc[begin:begin + AT_ONCE]


def encoded(docs: DataFrame, path: str, text: str = "text", with_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded``, which is
    NULL unless ``with_text``."""

    @F.pandas_udf("n_tokens long, ids binary, decoded string")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in sliced(parts):
            rows = [own.encode(t) for t in part]
            yield pd.DataFrame({"n_tokens": [len(a) // 4 for a, _ in rows], "ids": [a for a, _ in rows],
                                "decoded": [b if with_text else None for _, b in rows]})

    added = ("n_tokens", "ids", "decoded")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*kept, encode(whole(F.col(text))).alias("_made")).select(
        *kept, *[F.col(f"_made.{c}") for c in added])


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, and SHA-256 of the ids and of the decoded text.

    The digests are taken beside the codec, so ids and decoded texts leave no task.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in sliced(parts):
            rows = []
            for t in part:
                ids, decoded = own.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), digest(whole(F.col(text))).alias("_made")).select(key, "_made.*")
