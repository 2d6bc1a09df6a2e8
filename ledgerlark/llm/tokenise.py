"""Token ids of whole texts by the tokenizers library, a block of rows at a time.

A text is cut only where the pre-tokenizer cuts it anyway; equal pieces are encoded once and their ids gathered with numpy.
The cache of pieces is bounded (`CACHE` entries) and emptied when full, which changes the time taken and nothing else.

Edge cases: a null text counts as empty and has no ids; a text that holds the string of a special token is encoded whole by the
library, which makes that token of it; a very long text is a block of its own.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from ledgerlark.llm.common import SPACE, padded, ragged, span_hash, spans, text_blocks

CACHE = 500_000
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
for _b in range(0x21, 0x7F):
    (LETTER if chr(_b).isalpha() else MARK)[_b] = not chr(_b).isdigit() and chr(_b) != "'"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes blocks of texts with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.by_word = self.tok.normalizer is not None  # white space is dropped, so words are independent
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.data = np.zeros(1 << 16, np.int32)
        self.used = 0

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces that can be encoded alone, and each row's first piece.

        Besides white space, an ASCII letter next to ASCII punctuation (but for the apostrophe of contractions) is such a cut.
        """
        if not len(buf):
            return spans(buf, off)
        turn = np.flatnonzero(LETTER[buf[:-1]] & MARK[buf[1:]] | MARK[buf[:-1]] & LETTER[buf[1:]]) + 1
        if self.by_word:
            s, e, _ = spans(buf, off)
            turn = turn[~np.isin(turn, off)]
            s, e = np.sort(np.concatenate([s, turn])), np.sort(np.concatenate([e, turn]))
            return s, e, np.searchsorted(s, off)
        gap = SPACE[buf]
        at = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        p1 = buf[at - 1]
        if (p1 >= 0x80).any():  # other white space of Unicode before the cut belongs to the same run
            p2, p3 = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
            space = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
            space |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 >= 0x80) & (p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
            space |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
            at = at[~space]
        flag = np.zeros(len(buf) + 1, bool)
        flag[at] = True
        flag[turn] = True
        flag[off] = True
        s = np.flatnonzero(flag[:-1])
        return s, np.append(s[1:], len(buf)), np.searchsorted(s, off)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for i, raw in enumerate(pieces):
            text = raw.decode("utf-8")
            if self.by_word:
                # what the normalizer does to a plain word; anything unusual takes the whole path below
                word = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
                if word.isalpha() and "σ" not in word and "ς" not in word:
                    out[i] = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
                    continue
            else:
                body = text[1:] if text[0] == " " else text
                if body.isalpha():
                    out[i] = [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
                    continue
            rest.append(i)
        if rest:
            for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _slots(self, hashes: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.slot) + len(hashes) > CACHE and self.slot:
            self.clear()
        get = self.slot.get
        keys = hashes.tolist()
        found = [get(k, -1) for k in keys]
        new = [i for i, x in enumerate(found) if x < 0]
        if new:
            data = buf.tobytes()
            ids = self._ids([data[s[i] : e[i]] for i in new])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            n, k = int(sizes.sum()), len(self.slot)
            while self.used + n > len(self.data):
                self.data = np.concatenate([self.data, np.zeros_like(self.data)])
            while k + len(new) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.data[self.used : self.used + n] = np.fromiter((x for row in ids for x in row), np.int32, n)
            self.start[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.length[k : k + len(new)] = sizes
            self.used += n
            for j, i in enumerate(new):
                self.slot[keys[i]] = found[i] = k + j
        return np.array(found, np.int64)

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows, and where each row's ids begin (one more entry than rows)."""
        data = buf.tobytes()
        if any(x in data for x in self.specials):
            return self._whole(data, off)
        s, e, first = self.cuts(buf, off)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        _, at, back = np.unique(span_hash(padded(buf), s, e), return_index=True, return_inverse=True)
        slots = self._slots(_, buf, s[at], e[at])[back]
        n = self.length[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.data[ragged(self.start[slots], n)], ends[first]


    def _whole(self, data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`block` where some rows hold special tokens: these by the library at once, the others as ever."""
        out, bounds = [], [0]
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            row = data[a:b]
            if any(x in row for x in self.specials):
                out.append(np.array(self.tok.encode(row.decode(), add_special_tokens=False).ids, np.int32))
            else:
                out.append(self.block(np.frombuffer(row, np.uint8), np.array([0, b - a]))[0])
            bounds.append(bounds[-1] + len(out[-1]))
        return np.concatenate(out), np.array(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str):
    """(first row, end row, ids, row bounds) for blocks of a text column."""
    enc = encoder(path)
    for i, j, buf, off in text_blocks(column):
        yield i, j, *enc.block(buf, off)
