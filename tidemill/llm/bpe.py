"""Byte-level BPE ids through the tokenizers library, with each distinct word encoded once per worker.

The byte-level pre-tokenizer always breaks before white space that follows a non-space character, so a text can be
cut there and its pieces encoded apart. Pieces repeat: numpy cuts and hashes the pieces of many texts at once, an
open-addressing table from hash to ids answers for those seen before, and only new pieces go to the library. A text in
which some cut would not be such a break goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemill.llm.hashing import BYTE_TABLE, range_hashes

SPACE, NEWLINE, FIRST = " ", "\n", "\x01"
#: A worker's table of pieces: 19 bytes a slot, half of the slots used at most, and two bytes an id: 28 MB. Where new
#: pieces find no room, only those that were asked for again stay. It bounds the memory, not the result.
SLOTS, FLAT_IDS = 1 << 20, 1 << 22
RANGE_BYTES = 1 << 19  # of text looked up at once: its pieces and ids always have room in an empty table
UNSAFE = 0xFFFF  # in place of a piece's number of ids: its text must be encoded whole
_JOINED = 20_000  # pieces given to the library in one string
#: A word of one letter run, perhaps followed by one mark: two pre-tokens at most, whatever stands around it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


def _byte_char(b: int) -> str:
    """The character that stands for a byte in byte-level vocabularies; bytes 0x80 to 0xff but for these two runs stand for themselves."""
    return chr(256 + 33 + b - 127) if 127 <= b <= 160 else chr(256 + 33 + 34) if b == 173 else chr(b)


class PieceTable:
    """From a piece's hash and check value to its ids, in arrays made once and never grown. Zero is no hash."""

    def __init__(self, slots: int = SLOTS, ids: int = FLAT_IDS):
        self.mask = np.uint64(slots - 1)
        self.keys, self.checks = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32)
        self.offsets, self.sizes = np.zeros(slots, np.uint32), np.zeros(slots, np.uint16)
        self.again = np.zeros(slots, bool)
        self.flat = np.zeros(ids, np.uint16)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.again[:] = False
        self.count, self.used = 0, 0

    def thin(self) -> None:
        """Keep the pieces asked for again since they came or since the last thinning, or none if these are too many."""
        at = np.flatnonzero(self.again & (self.keys != 0))
        sizes = self.sizes[at]
        real = np.where(sizes == UNSAFE, 0, sizes).astype(np.int64)
        if 8 * len(at) > 3 * len(self.keys) or 4 * int(real.sum()) > 3 * len(self.flat):
            self.clear()
            return
        total = np.cumsum(real)
        raw = self.flat[np.repeat(self.offsets[at].astype(np.int64) - (total - real), real) + np.arange(int(real.sum()))]
        kept = self.keys[at], self.checks[at], sizes, raw
        self.clear()
        self._put(*kept)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.checks, self.offsets, self.sizes, self.again, self.flat))

    def holds(self, pieces: int, ids: int) -> bool:
        """Whether so many more pieces with so many ids have room."""
        return 2 * (self.count + pieces) <= len(self.keys) and self.used + ids <= len(self.flat)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int64)
        slot, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = (there == keys[todo]) & (self.checks[slot] == checks[todo])
            out[todo[hit]] = slot[hit]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes | None]) -> None:
        """New keys, each once, that the table ``holds``."""
        self._put(keys, checks, np.array([UNSAFE if i is None else len(i) // 2 for i in ids], np.uint16), np.frombuffer(b"".join(i or b"" for i in ids), "<u2"))

    def _put(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> None:
        real = np.where(sizes == UNSAFE, 0, sizes).astype(np.int64)
        offsets = self.used + np.cumsum(real) - real
        self.flat[self.used : self.used + len(raw)] = raw
        self.used += len(raw)
        self.count += len(keys)
        slot, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == 0
            at, who = slot[free], todo[free]
            # Of several that want one slot, the last to write it has it.
            self.offsets[at] = who
            won = self.offsets[at] == who
            at, who = at[won], who[won]
            self.keys[at], self.checks[at], self.sizes[at] = keys[who], checks[who], sizes[who]
            self.offsets[at] = offsets[who]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[won]] = False
            todo, slot = todo[left], (slot[left] + 1) & int(self.mask)


class WordCachedTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian uint16 bytes, equal to the library's own ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        if self._lib.get_vocab_size() > 65_536:
            raise ValueError("ids over 65,535 do not fit the two-byte form")
        self._special = [t.content for t in self._lib.get_added_tokens_decoder().values()]
        vocab = self._lib.get_vocab()
        self._model = self._lib.model
        # The byte-level alphabet writes the two bytes of these letters as two characters.
        self._letters = str.maketrans({chr(c): "".join(_byte_char(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)})
        self._marks = {m: np.array([vocab[m]], "<u2").tobytes() if m else b"" for m in ("", *".,;:!?")}
        self._newline = np.array([vocab["Ċ"]], "<u2").tobytes()
        starts = np.zeros((2, self._lib.get_vocab_size()), bool)
        for token, i in vocab.items():
            starts[0, i] = token.startswith("Ġ")
            starts[1, i] = token.startswith("Ċ")
        self._starts = {SPACE: starts[0], NEWLINE: starts[1]}
        self._table = PieceTable()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self._lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, bodies: list[str], lead: str) -> list[bytes]:
        """Ids of bodies that each follow ``lead``, found from one encoding of many."""
        out: list[bytes] = []
        for i in range(0, len(bodies), _JOINED):
            some = bodies[i : i + _JOINED]
            ids = np.array(self._lib.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(self._starts[lead][ids])
            if len(cuts) == len(some):
                raw, ends = ids.tobytes(), [*(2 * cuts[1:]).tolist(), 2 * len(ids)]
                out += [raw[a:b] for a, b in zip((2 * cuts).tolist(), ends, strict=True)]
            else:
                out += self._whole([lead + b for b in some])
        return out

    def _plain(self, word: str, mark: str, lead: str) -> bytes:
        tokens = self._model.tokenize(lead + (word if word.isascii() else word.translate(self._letters)))
        return array("H", [t.id for t in tokens]).tobytes() + self._marks[mark]

    def _learn(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces (a space, a line feed or, for a text's first, FIRST, and what follows); None where it cannot stand apart."""
        out: list[bytes | None] = [None] * len(pieces)
        spaced: list[int] = []
        bare: list[int] = []
        for k, p in enumerate(pieces):
            lead, body = p[0], p[1:]
            if m := _PLAIN.fullmatch(body):
                # A line feed before a letter is a token of its own, so what follows is as a text's first piece.
                ids = self._plain(m[1], m[2], "Ġ" if lead == SPACE else "")
                out[k] = self._newline + ids if lead == NEWLINE else ids
            elif body and not body[0].isspace() and not body[-1].isspace() and not any(s in body for s in self._special):
                (spaced if lead == SPACE else bare).append(k)
        for k, ids in zip(spaced, self._apart([pieces[k][1:] for k in spaced], SPACE), strict=True):
            out[k] = ids
        for k, ids in zip(bare, self._apart([pieces[k][1:] for k in bare], NEWLINE), strict=True):
            out[k] = ids if pieces[k][0] == NEWLINE else ids[len(self._newline) :]
        return [None if i is not None and len(i) // 2 >= UNSAFE else i for i in out]

    def _looked_up(self, data: bytes, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of each piece's ids; ``UNSAFE`` where it cannot stand apart)."""
        first, last = int(starts[0]), int(ends[-1])
        keys = range_hashes(BYTE_TABLE[x[first:last]], starts - first, ends - first)
        keys[keys == 0] = 1
        # Length, first, middle and last bytes: two pieces of one hash would have to share these too.
        size = ends - starts
        checks = (size.astype(np.uint32) << np.uint32(24)) ^ (x[np.minimum(starts + 1, ends - 1)].astype(np.uint32) << np.uint32(16)) ^ (x[starts + size // 2].astype(np.uint32) << np.uint32(8)) ^ x[ends - 1]
        t = self._table
        slot = t.find(keys, checks)
        t.again[slot[slot >= 0]] = True
        new = np.flatnonzero(slot < 0)
        if len(new):
            one = new[np.unique(keys[new], return_index=True)[1]]
            if not t.holds(len(one), int(size[one].sum())):  # a piece has no more ids than bytes
                t.thin()
                slot = t.find(keys, checks)
                new = np.flatnonzero(slot < 0)
                one = new[np.unique(keys[new], return_index=True)[1]]
                if not t.holds(len(one), int(size[one].sum())):
                    t.clear()
                    new = np.arange(len(keys))
                    one = np.unique(keys, return_index=True)[1]
            pieces = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            t.add(keys[one], checks[one], self._learn(pieces))
            slot[new] = t.find(keys[new], checks[new])
        sizes = np.where(slot < 0, UNSAFE, t.sizes[slot]).astype(np.int64)
        real = np.where(sizes == UNSAFE, 0, sizes)
        total = np.cumsum(real)
        return t.flat[np.repeat(t.offsets[slot].astype(np.int64) - (total - real), real) + np.arange(total[-1])], sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut = [k for k, t in enumerate(texts) if t and FIRST not in t]
        if cut:
            data = b"".join([b"\x01" + texts[k].encode("utf-8", "surrogatepass") for k in cut])
            x = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero((x == 0x20) | (x == 0x0A) | (x == 0x01))
            ends = np.append(starts[1:], len(x))
            parts, sizes, at = [], [], 0
            while at < len(starts):
                until = max(at + 1, int(np.searchsorted(ends, starts[at] + RANGE_BYTES, "right")))
                if ends[until - 1] - starts[at] > RANGE_BYTES:  # a single piece
                    parts.append(np.zeros(0, np.uint16))
                    sizes.append(np.full(1, UNSAFE, np.int64))
                else:
                    ids, n = self._looked_up(data, x, starts[at:until], ends[at:until])
                    parts.append(ids)
                    sizes.append(n)
                at = until
            size = np.concatenate(sizes)
            ids = np.concatenate(parts).astype("<u2").tobytes()
            first = np.flatnonzero(x[starts] == 0x01)
            whole = np.logical_or.reduceat(size == UNSAFE, first)
            size[size == UNSAFE] = 0
            stops = np.cumsum(size)[np.append(first[1:], len(starts)) - 1].tolist()
            at = 0
            for k, end, apart in zip(cut, stops, (~whole).tolist(), strict=True):
                if apart:
                    out[k] = ids[2 * at : 2 * end]
                at = end
        for k, ids_of in enumerate(out):
            if ids_of is None:
                out[k] = self._whole([texts[k]])[0] if texts[k] else b""
        return out


_made: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """One per worker and vocabulary."""
    if path not in _made:
        _made[path] = WordCachedTokenizer(path)
    return _made[path]


def slices(column: pa.Array, chars: int = 400_000, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Runs of the column's texts (null as empty) of about ``chars`` characters, as (start, list)."""
    start, some, n = 0, [], 0
    for at in range(0, len(column), rows):
        for i, t in enumerate(column.slice(at, rows).to_pylist(), at):
            some.append(t or "")
            n += len(some[-1])
            if n >= chars:
                yield start, some
                start, some, n = i + 1, [], 0
    if some:
        yield start, some
