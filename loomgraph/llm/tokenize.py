"""Byte-level BPE encoding by the tokenizers library, with what each chunk of text encodes to kept in a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from .common import binary_array, flat

#: Entries that one generation of the cache holds; two generations are kept.
CACHE_ENTRIES = 300_000
#: Longer chunks are encoded without being kept.
CACHED_CHARS = 48

#: Below it, what Python calls a letter is one for the library too, and has a byte map of at most two bytes.
LETTERS_END = "\u0250"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, equal to those of one call of the library over the whole text.

    The library first splits off the file's added tokens, special ones too; so does this, and what is between them is encoded alone.
    A byte-level BPE never merges over the edges that its pre-tokenizer sets. Such edges always stand before a space that
    a character other than white space follows, on both sides of a line feed that stands alone, and between a letter or
    digit and a mark that white space follows. Texts are cut there; of a batch each distinct chunk is looked up once, and
    the library's model encodes new ones.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError(f"{path}: added tokens that take white space or stand as words alone are not supported")
        self.added = {x.content: array("I", [k]).tobytes() for k, x in added.items()}
        # Of those that begin at one place the library takes the longest.
        self.splits = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.added, key=len, reverse=True))) if added else None
        self.tokenize, self.pre = self.library.model.tokenize, self.library.pre_tokenizer
        whole = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: whole.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self.shown |= {b: whole.pre_tokenize_str(chr(b))[0][0][1] for b in range(128, 192)}
        self.shown |= {b: whole.pre_tokenize_str(bytes([b, 128]).decode())[0][0][0] for b in range(194, 224)}
        self.new, self.old = {}, {}

    def _mapped(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Letters after a space or none are a piece as they stand; the library cuts all else but added tokens."""
        if chunk in self.added:
            return self.added[chunk]
        part = chunk[1:] if chunk[0] == " " else chunk
        if part.isalpha():
            if chunk.isascii():
                return self._mapped("Ġ" + part if len(part) < len(chunk) else part)
            if max(part) < LETTERS_END:
                return self._mapped(chunk.encode().decode("latin-1").translate(self.shown))
        return b"".join([self._mapped(mapped) for mapped, _ in self.pre.pre_tokenize_str(chunk)])

    def _find(self, chunks: list[str]) -> list[bytes]:
        """What chunks encode to. Two generations are kept: what was not asked for during one is forgotten."""
        found = list(map(self.new.get, chunks))
        for k in [k for k, x in enumerate(found) if x is None]:
            chunk = chunks[k]
            if (got := self.old.get(chunk)) is None:
                got = self._chunk(chunk)
            found[k] = got
            if len(chunk) <= CACHED_CHARS:
                if len(self.new) >= CACHE_ENTRIES:
                    self.old, self.new = self.new, {}
                self.new[chunk] = got
        return found

    def _added_at(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Begin and end of each added token within texts."""
        if self.splits is None:
            return np.zeros((0, 2), np.int64)
        # A match may also lie across two texts: both are searched again, alone.
        near = {int(np.searchsorted(at, x, "right")) - 1 for m in self.splits.finditer(raw) for x in (m.start(), m.end() - 1)}
        found = [(at[k] + m.start(), at[k] + m.end()) for k in sorted(near) for m in self.splits.finditer(raw[at[k] : at[k + 1]])]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; end follows each text's ids."""
        raw, at = flat(texts)
        added = self._added_at(raw, at)
        begins = cuts(raw, np.sort(np.concatenate([at, added.ravel()])))
        if len(added):  # they stay whole
            last = np.searchsorted(added[:, 0], begins) - 1
            begins = begins[(last < 0) | (begins >= added[last, 1])]
        coded = binary_array(raw, np.diff(np.append(begins, len(raw)))).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        found = self._find(coded.dictionary.cast(pa.string()).to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[code]
        out = ids[spread((np.cumsum(sizes) - sizes)[code], each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        bounds = sums[np.searchsorted(begins, at)]
        counts = np.diff(bounds)
        if end is None:
            return out, counts
        ended = np.full(len(out) + len(counts), end, "<u4")
        ended[np.arange(len(out)) + np.repeat(np.arange(len(counts)), counts)] = out
        return ended, counts + 1


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... for sizes[k] numbers, one k after another."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*b",.;:!?"]] = True
_PLAIN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: The first two bytes of characters of white space above ASCII (and of others, where a cut is then left out).
_WIDE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
#: Bytes that may end such a character.
_WIDE_END = np.zeros(256, bool)
_WIDE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, at spaces before anything but white space, and on both sides of a lone line feed."""
    if not len(raw):
        return np.zeros(0, np.int64)
    following = np.append(raw[1:], 32)
    solid = ~_WHITE[following]  # what follows a byte is not white space, nor in another text
    third = np.append(raw[2:], [0, 0])[: len(raw)]
    for a, b in _WIDE:
        solid &= ~((following == a) & (third == b))
    starts = at[:-1][np.diff(at) > 0]
    solid[starts[1:] - 1] = False
    before = np.concatenate([[True], _WHITE[raw[:-1]] | _WIDE_END[raw[:-1]]])
    before[starts] = True
    cut = (raw == 32) & solid
    lone = np.flatnonzero((raw == 10) & solid & ~before)
    cut[lone] = cut[lone + 1] = True
    cut[starts] = True
    marks = np.flatnonzero(_MARK[raw] & (_WHITE[following]))
    marks = marks[marks > 0]
    last = raw[marks - 1]
    wide = (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (raw[np.maximum(marks - 2, 0)] == 0xC3) & (marks > 1)
    cut[marks[(_PLAIN[last] | wide)]] = True
    return np.flatnonzero(cut)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)
