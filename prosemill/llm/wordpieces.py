"""Token ids of whole texts by a vocabulary of the tokenizers library, each distinct piece encoded once.

Texts are worked through as bytes. They are cut where the vocabulary's own pre-tokenizer
always cuts (spaces, line ends, before full stops and commas, between a letter and marks); pieces are known by a 64-bit
hash, which a table of bounded size maps to their ids. New pieces of plain letters are merged
here, all at once in arrays, by the ranks of the library's file; the library itself encodes
every other piece, and as a whole each text in which a cut could be wrong (white space side by
side, marks on both sides of a cut, a zero byte, very long pieces). Strings of special tokens
count as ordinary text. The tests hold the ids against the library's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from prosemill.llm.common import KEPT
from prosemill.llm.words import WordHasher, mix

#: The table of pieces is emptied when it holds so many.
MEMO = 600_000
LONGEST = 64
#: So many words are merged at once.
ROWS = 1 << 13
_SPACE = re.compile(r"\s")
#: What a pre-tokenizer takes for marks: U+001C to U+001F are none of its white space.
_MARKS = re.compile(r"[\x1c-\x1f]|[^\w\s]|_")
_LETTER, _AFTER_LETTER = np.zeros((2, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_AFTER_LETTER[list(b"!#$%&*;:?")] = True
_PLAIN, _ODD, _ENDS, _STARTS = 0, 1, 2, 4


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The vocabulary's merges as a hash table from pairs of ids to (rank, id)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.mask = (1 << 20) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.full(self.mask + 1, len(pairs), np.int32)
        self.made = np.zeros(self.mask + 1, np.int32)
        self.none = len(pairs)
        for k, (key, spot) in enumerate(zip(keys.tolist(), self._spot(keys).tolist(), strict=True)):
            while self.keys[spot] != -1:
                spot = (spot + 1) & self.mask
            self.keys[spot], self.rank[spot], self.made[spot] = key, k, vocab["".join(pairs[k])]

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or one whose rank says that it merges nothing."""
        keys = (a.astype(np.int64) << 32) | b
        spot = self._spot(keys)
        todo = np.flatnonzero((self.keys[spot] != keys) & (self.keys[spot] != -1))
        while len(todo):
            spot[todo] = (spot[todo] + 1) & self.mask
            todo = todo[(self.keys[spot[todo]] != keys[todo]) & (self.keys[spot[todo]] != -1)]
        return spot

    def ids(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of these sizes (a row of bytes each, what is behind the word does not matter): a matrix with ids to the left, and their numbers.

        Each step replaces the first pair of lowest rank of every word, as the library does.
        """
        n, length = words.shape
        sym, size, rows = self.inner[words], size.copy(), np.arange(n)
        sym[rows, size - 1] = self.last[words[rows, size - 1]]
        if length == 1:
            return sym, size
        slot = self.look_up(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, length - 1)
        rank = np.where(np.arange(length - 1) < size[:, None] - 1, self.rank[slot], self.none)
        live = np.arange(n)
        out = sym.copy()
        while True:
            at = rank.argmin(1)
            rows = np.arange(len(live))
            go = rank[rows, at] < self.none
            if not go.all():
                out[live[~go], : sym.shape[1]] = sym[~go]
                live, sym, slot, rank, at = live[go], sym[go], slot[go], rank[go], at[go]
                rows = np.arange(len(live))
            if not len(live):
                return out, size
            size[live] -= 1
            made = self.made[slot[rows, at]]
            after = np.arange(sym.shape[1] - 1) >= at[:, None] + 1
            sym = np.where(after, sym[:, 1:], sym[:, :-1])
            sym[rows, at] = made
            if rank.shape[1] == 1:
                out[live, :1] = sym
                return out, size
            rank, slot = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1]), np.where(after[:, :-1], slot[:, 1:], slot[:, :-1])
            # The pairs beside the new symbol; padding at the end merges nothing.
            for side, has in ((at - 1, at > 0), (at, at < size[live] - 1)):
                r, c = rows[has], side[has]
                s = self.look_up(sym[r, c], sym[r, c + 1])
                slot[r, c], rank[r, c] = s, self.rank[s]
            gone = rows[at >= size[live] - 1]
            keep = at[gone] < rank.shape[1]
            rank[gone[keep], at[gone[keep]]] = self.none


class Table:
    """64-bit keys to numbers in order of arrival, by open addressing; it grows when two thirds full."""

    def __init__(self, bits: int = 20):
        self._clear(bits)
        self.n = 0

    def _clear(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.number = np.full(self.mask + 1, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers; -1 where they are new."""
        spot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        number = self.number[spot]
        todo = np.flatnonzero((self.keys[spot] != keys) & (number >= 0))
        while len(todo):
            spot[todo] = at = (spot[todo] + 1) & self.mask
            number[todo] = own = self.number[at]
            todo = todo[(self.keys[at] != keys[todo]) & (own >= 0)]
        return number

    def add(self, keys: np.ndarray) -> None:
        """Distinct new keys."""
        number = self.n + np.arange(len(keys), dtype=np.int32)
        self.n += len(keys)
        if 3 * self.n > 2 * self.mask:
            held = np.flatnonzero(self.number >= 0)
            keys, number = np.concatenate([self.keys[held], keys]), np.concatenate([self.number[held], number])
            self._clear(max(self.bits + 1, int(3 * self.n // 2).bit_length()))
        spot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.number[spot[todo]] < 0]
            _, one = np.unique(spot[free], return_index=True)
            put = free[one]
            self.keys[spot[put]], self.number[spot[put]] = keys[put], number[put]
            todo = todo[self.number[spot[todo]] != number[todo]]
            spot[todo] = (spot[todo] + 1) & self.mask


class Pieces:
    """``spaced``: a space belongs to the word after it (byte-level); else white space is dropped and case folded."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(path)
        self.spaced = spaced
        self.hasher = WordHasher(lower=not spaced)
        self.reset()

    def reset(self) -> None:
        self.memo = Table()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        #: Of each piece: 1 a cut beside it could be wrong, 2 it ends in a mark, 4 it starts with one.
        self.kind = np.zeros(1 << 16, np.uint8)

    def _kind(self, p: str) -> int:
        word = p if self.spaced else unicodedata.normalize("NFC", p).lower()
        kind = (_ENDS if word and _MARKS.match(word[-1]) else 0) | (_STARTS if word and _MARKS.match(word[0]) else 0)
        if not self.spaced:
            # Other white space inside is a cut of its own; beside a cut it is one with the space there, and both go.
            return kind | (_ODD if word and unicodedata.combining(word[0]) else 0)
        if p != "\n" and (p in ("", " ") or _SPACE.search(p, 1) is not None or (p[0] != " " and p[0].isspace())):
            kind |= _ODD
        return kind

    def _keep(self, ids: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> None:
        """Appends pieces to the table, in order."""
        first, n = self.memo.n - len(sizes), len(sizes)
        while self.memo.n > len(self.at):
            self.at, self.size, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.kind))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n], self.kind[first : first + n] = sizes, kinds
        self.used += len(ids)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> None:
        """New distinct pieces: plain ones are merged here, those of like lengths together, the rest goes to the library."""
        size = end - start
        like = np.where(plain, (size + 1) // 2, 0)
        for k in np.unique(like[plain]).tolist():
            alike = np.flatnonzero(like == k)
            for lo in range(0, len(alike), ROWS):
                own = alike[lo : lo + ROWS]
                ids, sizes = self.merges.ids(low[np.minimum(start[own][:, None] + np.arange(2 * k), len(low) - 1)], size[own])
                self.memo.add(keys[own])
                self._keep(ids[np.arange(2 * k) < sizes[:, None]].astype(np.uint32), sizes, np.zeros(len(own), np.uint8))
        rest = np.flatnonzero(~plain)
        if len(rest):
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            self.memo.add(keys[rest])
            self._keep(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes, np.array([self._kind(t) for t in texts], np.uint8))

    def _cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces; zero bytes part the texts."""
        space, line, part = raw == 32, raw == 10, raw == 0
        begin = (raw == 46) | (raw == 44)
        gap = part if self.spaced else part | line | space
        if self.spaced:
            begin |= space | line
            begin[1:] |= line[:-1]
        else:
            # Marks behind a letter are a piece of their own to this kind of vocabulary.
            begin[1:] |= _AFTER_LETTER[raw[1:]] & _LETTER[raw[:-1]]
        begin[1:] |= gap[:-1]
        begin[:1] = True
        begin &= ~gap
        start = np.flatnonzero(begin)
        edge = np.flatnonzero(begin | gap)
        return start, np.append(edge, len(raw))[np.searchsorted(edge, start) + 1] if len(start) else start

    def _letters(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes belong to letters below U+0100, and the bytes as the vocabulary folds them."""
        ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
        second = np.zeros(len(raw), bool)
        second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        ok = ascii_letter | second
        ok[:-1] |= second[1:]
        if self.spaced:
            return ok, raw
        fold = (ascii_letter & (raw < 97)) | (second & (raw <= 0x9E))
        return ok, raw + np.where(fold, 32, 0).astype(np.uint8)

    def encode(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.memo.n > MEMO:
            self.reset()
        own = [t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts]
        whole = {i: None for i, t in enumerate(own) if b"\0" in t}
        raw = np.frombuffer(b"\0".join(b"" if i in whole else t for i, t in enumerate(own)), np.uint8)
        sizes = np.fromiter((0 if i in whole else len(t) for i, t in enumerate(own)), np.int64, len(own))
        first = np.cumsum(sizes + 1) - (sizes + 1)
        start, end = self._cut(raw)
        cuts = np.concatenate([np.searchsorted(start, first), [len(start)]])
        odd = end - start > LONGEST
        keys = self.hasher.spans(raw, start, end)
        idx = self.memo.find(keys)
        new = np.flatnonzero((idx < 0) & ~odd)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            ok, low = self._letters(raw)
            letters = np.concatenate([[0], np.cumsum(ok)])
            a, b = start[new], end[new]
            lead = (raw[a] == 32).astype(np.int64) if self.spaced else 0
            plain = (letters[b] - letters[a] == b - a - lead) & (b - a > lead)
            self._learn(keys[new], raw, low, a, b, plain)
            idx = self.memo.find(keys)
        idx = np.where(odd, 0, idx)
        n = np.where(odd, 0, self.size[idx]).astype(np.int64) if len(idx) else np.zeros(0, np.int64)
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        flat = self.flat[np.repeat(self.at[idx] - (stop - n), n) + np.arange(total)] if len(idx) else np.zeros(0, np.uint32)
        kind = self.kind[idx]
        odd = odd | ((kind & _ODD) > 0)
        # Marks side by side are one piece to the library; a space parts them where it is kept with what follows.
        odd[:-1] |= ((kind[:-1] & _ENDS) > 0) & ((kind[1:] & _STARTS) > 0) & (start[1:] == end[:-1])
        if self.spaced:  # line ends side by side are one piece, too
            odd[:-1] |= (raw[start[:-1]] == 10) & (raw[start[1:]] == 10)
        wrong = np.concatenate([[0], np.cumsum(odd)])
        stop = np.concatenate([[0], stop])
        out = []
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if wrong[hi] > wrong[lo]:
                whole[i] = None
            out.append(flat[stop[lo] : stop[hi]])
        if whole:
            names = [own[i].decode("utf-8", "replace") for i in whole]
            for i, e in zip(whole, self.tokenizer.encode_batch_fast(names, add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out


def pieces_for(path: str, spaced: bool) -> Pieces:
    """One encoder a worker process: its table serves all tasks there, and memory is taken once."""
    if (path, spaced) not in KEPT:
        KEPT.clear()
        KEPT[path, spaced] = Pieces(path, spaced)
    return KEPT[path, spaced]


def in_blocks(texts: list, size: int = 1 << 20):
    """Ranges of texts of about so many characters or bytes, for bounded memory."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
