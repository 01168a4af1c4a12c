"""Byte-level BPE with the tokenizers library: encoding over Arrow batches, and decoding by the byte table.

A text is cut into units at each single space between two non-space characters; no match of the pretoken pattern
spans such a place and none depends on what lies before it, so units are encoded independently. A worker keeps the
ids of the units it has met; only new units pass the pretoken pattern, and their pretokens, written with one character
for each byte, go to the library in one batch. The library returns ids without places, so the places come from the
lengths of the tokens: each id stands for a fixed number of bytes.

Null texts encode as empty, empty texts to no ids; texts of any length are encoded whole, unit by unit.
"""

from __future__ import annotations

import base64
import gc
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

#: Units that a worker keeps, at most; then it starts anew. About 180 bytes each.
KEEP_UNITS = 600_000
#: Pretokens of one call of the library.
CALL = 4000
#: White space other than spaces and newlines.
OTHER_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_SPACE = OTHER_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.zeros(0, np.int64)


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, otherwise from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(dict(enumerate(byte_characters())))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Joins the adjacent pair of least rank, the first of equals, while there is one of a rank under ``below``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def model_from_ranks(ranks: dict[bytes, int]) -> str:
    """The library's own description of a BPE model with these ranks: each token's pair is what lower ranks leave of it."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(pair := merge(token, ranks, rank)) == 2:
            merges.append([to_characters(pair[0]), to_characters(pair[1])])
    vocab = {to_characters(token): rank for token, rank in ranks.items()}
    return json.dumps({"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": merges}})


def model_from_file(path: str) -> str:
    """The description in a tokenizer file, without its own splitting. Its added tokens stay: they are found in a text first."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    return json.dumps({"version": "1.0", "added_tokens": whole["added_tokens"], "model": whole["model"]})


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self, asked: list, prefix: str):
        super().__init__()
        self.asked, self.prefix = asked, prefix

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self.asked)
        self.asked.append(self.prefix + key)
        return number


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class ByteBpe:
    """Encodes and decodes with one model; kept by a worker for all its tasks."""

    def __init__(self, model: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        whole = json.loads(model)
        #: Tokens that are found in a text as they stand, before it is split: their ids.
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.library = Tokenizer.from_str(json.dumps({**whole, "added_tokens": []}))
        self.pattern = regex.compile(pattern)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.lut = np.array([*map(ord, byte_characters())], "<u2")
        self.lut[0xFF] = ord(" ")  # no byte of UTF-8: between pretokens
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.kind = np.dtype("<u2") if len(self.bytes_of) <= 1 << 16 else np.dtype("<u4")
        self.forget()

    def forget(self) -> None:
        self.asked: list[str] = list(self.added)  # units by number
        self.spaced, self.plain = Numbered(self.asked, " "), Numbered(self.asked, "")
        self.plain.update((token, i) for i, token in enumerate(self.added))
        self.done = n = len(self.asked)  # units of lower numbers are encoded
        self.flat, self.starts, self.sizes = np.array(list(self.added.values()), self.kind), np.arange(n), np.ones(n, np.int64)

    def pretokens(self, unit: str) -> list[str]:
        """The matches of the pattern; a space, letters, and one mark at most are split without it."""
        if unit[:1] == " ":
            if unit[1:].isalpha():
                return [unit]
            if unit[-1] in ".,!?;:" and unit[1:-1].isalpha():
                return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def learn(self) -> None:
        """Encodes the units that were not met before."""
        found = list(map(self.pretokens, self.asked[self.done :]))
        self.asked[self.done :] = [""] * len(found)
        self.done = len(self.asked)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        number = Numbered([], "")
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, counts.sum())
        written = self.lut[np.frombuffer(b"\xff".join(map(str.encode, number.asked)) + b"\xff", np.uint8)]
        ends = np.flatnonzero(written == ord(" "))
        words = written.tobytes().decode("utf-16-le").split(" ")[:-1]
        calls = [words[i : i + CALL] for i in range(0, len(words), CALL)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.library.encode_batch_fast(calls, is_pretokenized=True, add_special_tokens=False)])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends - np.arange(len(ends)), "right")
        sizes = np.diff(cuts, prepend=0)
        own = sizes[which]
        per_unit = np.add.reduceat(own, np.cumsum(counts) - counts) if len(own) else own
        starts = len(self.flat) + np.cumsum(per_unit) - per_unit
        self.flat = np.concatenate([self.flat, ids[ragged((cuts - sizes)[which], own)].astype(self.kind)])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, per_unit])

    def units(self, text: str) -> list[str]:
        """Each unit begins with the space before it, but for the first; runs of white space stay in one unit."""
        units, open_ = [], ""
        for k, piece in enumerate(text.split(" ")):
            piece = " " + piece if k else piece
            if open_ and (open_[-1].isspace() or len(piece) < 2 or piece[1].isspace()):
                open_ += piece
            else:
                if open_:
                    units.append(open_)
                open_ = piece
        return units + [open_] if open_ else units

    def numbers(self, text: str | None) -> np.ndarray:
        if not text:
            return NONE
        if any(token in text for token in self.added):
            found, at = [], 0
            for hit in self.at_added.finditer(text):
                found += [self.ordinary(text[at : hit.start()]), np.array([self.plain[hit[0]]])]
                at = hit.end()
            return np.concatenate([*found, self.ordinary(text[at:])])
        return self.ordinary(text)

    def ordinary(self, text: str) -> np.ndarray:
        """Units of a text without added tokens."""
        if not text:
            return NONE
        odd = "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()
        if odd or any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACE)):
            units = self.units(text)
            return np.fromiter((self.spaced[u[1:]] if u[0] == " " else self.plain[u] for u in units), np.int64, len(units))
        pieces = text.split(" ")
        first = self.plain[pieces[0]]
        numbers = np.fromiter(map(self.spaced.__getitem__, pieces), np.int64, len(pieces))
        numbers[0] = first
        return numbers

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.asked) > KEEP_UNITS:
            self.forget()
        each = list(map(self.numbers, texts))
        if self.done < len(self.asked):
            collects = gc.isenabled()
            gc.disable()  # it would go through all lists of new units again and again; they make no cycles
            try:
                self.learn()
            finally:
                if collects:
                    gc.enable()
        units = np.concatenate([NONE, *each])
        sizes = self.sizes[units] if len(units) else units
        flat = self.flat[ragged(self.starts[units], sizes)] if len(units) else self.flat[:0]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x) for x in each], dtype=np.int64)]
        return np.split(flat, ends[:-1]) if len(each) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids joined: a character whose bytes lie in several tokens is whole again."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_text(self, ids: np.ndarray) -> str:
        """The text; bytes that form no character (of ids cut inside one) become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """For each id the byte at which it starts, and last the byte at which all end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


_LOADED: dict[int, ByteBpe] = {}


def loaded(model: str, pattern: str) -> ByteBpe:
    """The worker's encoder of this model: later tasks of the worker use it, and the units it knows, again."""
    key = hash((model, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(model, pattern)
    return _LOADED[key]
