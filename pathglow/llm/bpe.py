"""Byte-pair encoding with the vocabulary files of public tokenizers.

Two ways to merge are built on one heap-and-linked-list loop: ``merged`` returns the symbols that remain, ``merge_count``
only how many merges happen. ``ForcedBoundaryEncoder`` cuts words at byte pairs that occur inside no vocabulary token: no
merge can ever join such a pair, so the fragments on either side are encoded on their own and concatenated.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import regex

from pathglow.llm.common import Memo, held

#: Unicode's White_Space, as the tokenizers' regular expressions see it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Keys longer than this are computed each time: they hardly recur and would fill the memo.
LONGEST_KEY = 48
POSITION = (1 << 32) - 1
SHORT, NEVER = 40, 1 << 31
MARKS = set(".,!?;:")


class ShortMemo(Memo):
    """A memo that holds short keys only."""

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


#: Letters and numbers that Unicode 16.0 adds to 15.1, and capitals that 16.0 and 17.0 add, with the
#: distance to their small letters. The tokenizers know these versions.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
SMALL_LETTER = {c: c + shift for first, last, shift in NEW_CAPITALS for c in range(first, last + 1)}


@lru_cache
def letters_and_numbers() -> tuple[str, str, str]:
    """Letters and numbers as ranges of a regular expression, and those characters on which the ``regex`` module differs.

    It knows a later Unicode than the tokenizers, in which more characters are letters.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))  # no letters or numbers lie beyond
    known = [unicodedata.category(c)[0] for c in every]
    ours = [{c for c, k in zip(every, known, strict=True) if k == kind} | {chr(c) for a, b in new for c in range(a, b + 1)} for kind, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS))]
    theirs = [set(regex.findall(rf"\p{{{kind}}}", every)) for kind in "LN"]
    return (*map(_ranges, ours), _ranges((ours[0] ^ theirs[0]) | (ours[1] ^ theirs[1])))


def _ranges(characters: set[str]) -> str:
    codes = np.sort(np.fromiter(map(ord, characters), np.int64, len(characters)))
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs if len(r))


class Pattern:
    """A regular expression over letters and numbers; texts with characters on which ``regex`` differs take a slower one."""

    def __init__(self, pattern: str):
        letters, numbers, odd = letters_and_numbers()
        self.plain = regex.compile(pattern.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
        self.exact = regex.compile(pattern.replace("[{L}]", f"[{letters}]").replace("[{N}]", f"[{numbers}]").replace("{L}", letters).replace("{N}", numbers))
        self.odd = regex.compile(f"[{odd}]") if odd else None

    def findall(self, text: str) -> list[str]:
        exact = self.odd is not None and not text.isascii() and self.odd.search(text)
        return (self.exact if exact else self.plain).findall(text)


@lru_cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others for 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Rank and product of every pair of symbol ids that a tokenizer merges."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.rank: dict[int, int] = {}
        self.product: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.product.append(vocab[a + b])

    def _run(self, symbols: list[int]) -> int:
        """Merges in place, lowest rank first and leftmost first within a rank; dead places hold -1."""
        n, rank, product = len(symbols), self.rank, self.product
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i, r = top & POSITION, top >> 32
            if symbols[i] < 0 or (j := after[i]) >= n or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # an end of this pair has been merged since
            merges += 1
            symbols[i], symbols[j] = product[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, q << 32 | i)
            p = before[i]
            if p >= 0 and (q := rank.get(symbols[p] << 32 | symbols[i])) is not None:
                heappush(heap, q << 32 | p)
        return merges

    def merged(self, symbols: list[int], ranks: list[int] | None = None) -> list[int]:
        """The symbols that remain; ``ranks`` of the neighbours, NEVER for those that do not merge, if they are known."""
        if len(symbols) > SHORT:
            self._run(symbols)
            return [s for s in symbols if s >= 0]
        # few symbols: a plain search for the least rank is quicker than a heap
        rank, product = self.rank.get, self.product
        if ranks is None:
            ranks = [rank(a << 32 | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            symbols[i] = product[least]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] << 32 | symbols[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] << 32 | symbols[i + 1], NEVER)
        return symbols

    def merge_count(self, symbols: list[int]) -> int:
        return self._run(symbols)


class ForcedBoundaryEncoder:
    """Encoder and decoder of a word BPE file: lower case, white space dropped, word ends marked by a suffix."""

    SUFFIX = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.merges = Merges(vocab, merges)
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.SUFFIX] for s in symbols]
        #: Ranks of two bytes side by side, the second inside a word or at its end: tables, as every new word asks for them.
        self.first_ranks, self.final_ranks = ([[self.merges.rank.get(a << 32 | b, NEVER) for b in then] for a in self.inner] for then in (self.inner, self.final))
        self.joinable = [bytearray(256) for _ in range(256)]
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.SUFFIX)]
            for a, b in zip(raw, raw[1:], strict=False):
                self.joinable[a][b] = 1
        self.special = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.word = Pattern(rf"'s|'t|'re|'ve|'m|'ll|'d|[{{L}}]+|[{{N}}]|[^{SPACES}{{L}}{{N}}]+")
        self.inner_memo = ShortMemo(lambda f: self._encode(f, last=False), 100_000)
        self.final_memo = ShortMemo(lambda f: self._encode(f, last=True), 100_000)
        self.words = ShortMemo(self._word, 400_000)
        self.chunks = ShortMemo(self._chunk, 600_000)

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut wherever two bytes stand together in no vocabulary token."""
        cuts = [i + 1 for i in range(len(raw) - 1) if not self.joinable[raw[i]][raw[i + 1]]]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)] if cuts else [raw]

    def _encode(self, raw: bytes, last: bool) -> bytes:
        inner, ranks_of = self.inner, self.first_ranks
        symbols, ranks = [inner[b] for b in raw], [ranks_of[a][b] for a, b in pairwise(raw)]
        if last:
            symbols[-1] = self.final[raw[-1]]
            if ranks:
                ranks[-1] = self.final_ranks[raw[-2]][raw[-1]]
        return array("I", self.merges.merged(symbols, ranks)).tobytes()

    def _word(self, word: str) -> bytes:
        pieces = self.fragments(word.encode())
        if len(pieces) == 1:
            return self._encode(pieces[0], last=True)
        return b"".join(map(self.inner_memo.__getitem__, pieces[:-1])) + self.final_memo[pieces[-1]]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # one character at a time: str.lower() would give a word-final sigma a form of its own
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if not text.isascii():
            text = text.translate(SMALL_LETTER)
        if text.isalpha():  # letters alone, or letters and a mark, need no regular expression
            return self.words[text]
        if text[-1:] in MARKS and text[:-1].isalpha():
            return self.words[text[:-1]] + self.words[text[-1]]
        return b"".join(map(self.words.__getitem__, self.word.findall(text)))

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # letters of ASCII alone
            return self.words[chunk.lower().decode()]
        text = chunk.decode()
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special.get(p) or self._plain(p) for p in self.special_split.split(text) if p)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. No token spans white space, so chunks between it are memoised."""
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))

    def decode(self, ids: bytes) -> str:
        """The tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class TokenCounter:
    """Counts the tokens of a byte-level BPE file without emitting an identifier."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]])
        self.symbols = [vocab[s] for s in byte_symbols()]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.token = Pattern(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{{L}}]+| ?[{{N}}]+| ?[^{SPACES}{{L}}{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        #: Other white space than ASCII's, and what only some engines take for it: such texts go the plain way.
        self.odd = regex.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.coarse = regex.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
        self.words = ShortMemo(self._word, 500_000)
        self.chunks = ShortMemo(self._chunk, 500_000)

    def _word(self, word: str) -> int:
        """Initial symbols minus merges."""
        symbols = [self.symbols[b] for b in word.encode()]
        return len(symbols) - self.merges.merge_count(symbols)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.token.findall(chunk)))

    def _plain(self, text: str) -> int:
        if self.odd.search(text):
            return self._chunk(text)
        return sum(map(self.chunks.__getitem__, self.coarse.findall(text)))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of this worker process, kept with its memos over the tasks that the worker runs."""
    return held("encoder", path, lambda: ForcedBoundaryEncoder(path))


def counter(path: str) -> TokenCounter:
    return held("counter", path, lambda: TokenCounter(path))
