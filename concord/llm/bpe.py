"""Byte-pair merging of many words at once, on ragged numpy arrays."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
SLOT_BITS = 19

# Fixed value: the words of the vocabulary file; what lies between them is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones stand for themselves, the others
    for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


LETTER, DIGIT, OTHER, SPACE = range(4)


def _kinds() -> np.ndarray:
    """The kind of each Latin letter, as WORDS tells them apart."""
    kinds = np.full(0x180, OTHER, dtype=np.uint8)
    for point in range(0x180):
        category = unicodedata.category(chr(point))[0]
        kinds[point] = LETTER if category == "L" else DIGIT if category == "N" else SPACE if regex.match(r"\p{White_Space}", chr(point)) else OTHER
    return kinds


KINDS = _kinds()


class Merger:
    """The merges of a BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.letter_of = letters
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in letters], dtype=np.int32)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        left, right, product = (np.empty(len(spec["model"]["merges"]), dtype=np.int64) for _ in range(3))
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left[rank], right[rank], product[rank] = vocabulary[a], vocabulary[b], vocabulary[a + b]
        keys = (left << 20) | right
        self.product = product.astype(np.int32)
        self._fill(keys)
        # A merge is safe if its product takes part in later merges only: then all its places in a word can
        # be merged in one step; else the leftmost one goes first, as the library does.
        first_use = np.full(int(max(vocabulary.values())) + 1, NONE, dtype=np.int64)
        for side in (left, right):
            np.minimum.at(first_use, side, np.arange(len(side)))
        self.safe = first_use[product] > np.arange(len(product))
        self.library = Tokenizer.from_file(path)

    def words(self, chunk: str) -> tuple[list[bytes], int]:
        """The pre-tokens of a piece of text, and how many special tokens stand in it."""
        if self.special is not None and "<|" in chunk and (found := self.special.findall(chunk)):
            parts = [self.words(p)[0] for p in self.special.split(chunk)]
            return [w for p in parts for w in p], len(found)
        if chunk.isascii():
            return [w.encode() for w in WORDS.findall(chunk.lower())], 0
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in pieces], 0

    def plain(self, piece: str) -> bool:
        """Whether `count_plain` may take the piece: Latin letters without apostrophes or marks of special tokens."""
        return "'" not in piece and "<|" not in piece and (piece.isascii() or (max(piece) < "\u0180" and "\u0130" not in piece))

    def count_plain(self, pieces: list[str]) -> np.ndarray:
        """Tokens of pieces without blanks for which `plain` holds; words are told apart in arrays."""
        return self._merge(*self._plain_symbols(pieces), len(pieces))

    def ids_plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens themselves, one piece after the other, and their numbers."""
        left: list[tuple[np.ndarray, np.ndarray]] = []
        counts = self._merge(*self._plain_symbols(pieces), len(pieces), left)
        owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in left)])
        symbols = np.concatenate([np.zeros(0, np.int32), *(x for _, x in left)])
        return symbols[np.argsort(owner, kind="stable")], counts

    def _plain_symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(pieces).lower() + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = KINDS[points]
        flat = np.frombuffer(joined.encode(), dtype=np.uint8)
        last_byte = np.cumsum(1 + (points > 0x7F)) - 1
        ends = (kind != SPACE) & ((kind == DIGIT) | (kind != np.append(kind[1:], SPACE)))
        symbols = self.inner[flat]
        at = last_byte[ends]
        symbols[at] = self.last[flat[at]]
        blank = flat == 0x0A
        owner = np.cumsum(blank)
        if (kind == SPACE).sum() > blank.sum():  # white space other than the blanks at which texts are cut
            blank[last_byte[kind == SPACE]] = True
            blank |= (flat == 0xC2) & np.append(blank[1:], False)
        return symbols[~blank], owner[~blank]

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each word when no pair can be merged."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[flat[ends]]
        return self._merge(symbols, np.repeat(np.arange(len(words)), sizes), len(words))

    def _fill(self, keys: np.ndarray) -> None:
        """An open hash table of the pairs, in two arrays."""
        self.slot_keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << SLOT_BITS, NONE, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.slot_keys[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 20) | right
        slots = self._slots(wanted)
        there = self.slot_keys[slots]
        ranks = np.where(there == wanted, self.slot_ranks[slots], NONE)
        open_ = np.flatnonzero((there != wanted) & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << SLOT_BITS) - 1)
            there = self.slot_keys[slots[open_]]
            same = there == wanted[open_]
            ranks[open_[same]] = self.slot_ranks[slots[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return ranks

    def _merge(self, symbols: np.ndarray, owner: np.ndarray, number: int, left: list | None = None) -> np.ndarray:
        """Symbols left per owner. Last letters of words are symbols that start no pair, so words stay apart.

        `left` gets the owners and symbols that are left, in parts; a part holds whole owners, in order.
        """
        counts = np.zeros(number, dtype=np.int64)
        ranks = self._ranks(symbols, np.append(symbols[1:], 0))
        ranks[np.append(owner[1:] != owner[:-1], True)[: len(ranks)]] = NONE
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            low = np.minimum.reduceat(ranks, starts)
            done = low == NONE
            counts[owner[starts[done]]] = sizes[done]
            if left is not None and done.any():
                ended = np.repeat(done, sizes)
                left.append((owner[ended], symbols[ended]))
            if done.all():
                break
            hit = (ranks == np.repeat(low, sizes)) & (ranks != NONE)
            at = np.flatnonzero(hit)
            # Of places side by side (a pair of equal symbols) every second one; of unsafe merges the leftmost.
            run = np.append(True, np.diff(at) > 1)
            inside = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            keep = inside % 2 == 0
            unsafe = ~self.safe[ranks[at]]
            if unsafe.any():
                leading = np.append(True, owner[at[1:]] != owner[at[:-1]])
                keep &= ~unsafe | leading
            at = at[keep]
            symbols[at] = self.product[ranks[at]]
            stay = np.repeat(~done, sizes)
            dirty = np.zeros(len(symbols), dtype=bool)
            dirty[at] = True
            dirty[at[at > 0] - 1] = True
            # The symbol before a dropped one may be the merged pair two places back.
            gone = at + 1
            stay[gone] = False
            back = at[at > 1] - 2
            dirty[back] = True
            symbols, owner, ranks, dirty = symbols[stay], owner[stay], ranks[stay], np.flatnonzero(dirty[stay])
            if not len(symbols):
                break
            following = np.minimum(dirty + 1, len(symbols) - 1)
            fresh = self._ranks(symbols[dirty], symbols[following])
            ranks[dirty] = np.where((following > dirty) & (owner[following] == owner[dirty]), fresh, NONE)
        return counts
