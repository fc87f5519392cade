"""Byte-level BPE of whole texts; every distinct piece of text is encoded once per worker and then looked up.

A byte-level BPE cuts text by ``'s|..| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` first.  No match reaches from a
non-space into white space or from a letter into a sign or digit, and the pattern looks only ahead.  So a text may be cut
at each such place, the pieces encoded alone, and the ids put together again: they are the ids of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa

from quaestor.llm.common import INVERSE, PRIME, give_back, mix, powers, stretches

#: Pieces remembered per worker; a full memory starts anew (results do not depend on it).
REMEMBERED = 1_200_000
#: Bytes of text looked at together; some fifty bytes of numbers are held for each.
STRETCH = 1 << 19
_encoders: dict[int, "Encoder"] = {}


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_LETTER = _table([*range(65, 91), *range(97, 123)])
_ASCII_OTHER = ~_LETTER & (np.arange(256) < 128)
#: ASCII bytes that some engine counts as white space, and the last two bytes of white space beyond ASCII.
_BLANK = _table([*range(9, 14), *range(28, 33)])
_WIDE_LAST = _table([0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
_WIDE_BEFORE = _table([0xC2, 0x9A, 0x80, 0x81])
_GAP = _table([10, 32])
#: One match of the pattern in every version of Unicode: letters up to U+024F.
_WORD = re.compile(" ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,38}").fullmatch
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that stand for the bytes in a byte-level vocabulary: printed ones for themselves, others from U+0100 on.
_CHARACTERS = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_LINE_END = chr(_CHARACTERS[10])


def cuts(raw: np.ndarray) -> np.ndarray:
    """Boolean per byte: a piece may start here (the first byte aside)."""
    before, two = raw[:-1], np.concatenate([[np.uint8(0)], raw[:-2]])
    solid = ~_BLANK[before] & ~(_WIDE_LAST[before] & _WIDE_BEFORE[two])
    # letters of Latin-1: 0xC3 and a second byte other than those of the signs for times and divided by
    letter = _LETTER[before] | ((two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    return np.concatenate([[True], (_GAP[raw[1:]] & solid) | (_ASCII_OTHER[raw[1:]] & letter)])


class Remembered:
    """Encodes text columns through a function that encodes a list of pieces, each once."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]]):
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(0, "<u4"), 0

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        found = self._encode(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.place), int(sizes.sum())
        if self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(total, len(self.store), 1 << 16), "<u4")])
        self.store[self.used : self.used + total] = np.concatenate(found)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += total
        self.place.update(zip(keys, range(first, first + len(keys))))

    def _places(self, keys: list[int], piece: Callable[[int], str]) -> np.ndarray:
        found = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0).tolist()
        if new and self.place and len(self.place) + len(new) > REMEMBERED:
            self._forget()
            return self._places(keys, piece)
        if new:
            found[new] = np.arange(len(new)) + len(self.place)
            self._learn([keys[k] for k in new], [piece(k) for k in new])
        return found

    def _keep_whole(self, raw: np.ndarray, mark: np.ndarray) -> None:
        """Take back cuts inside stretches of text that stand for one id."""

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first row, ids, offsets): row first + i of the column has ids[offsets[i]:offsets[i + 1]]."""
        for first, raw, bounds in stretches(column, STRETCH):
            if not len(raw):
                yield first, np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
                continue
            mark = cuts(raw)
            self._keep_whole(raw, mark)
            mark[bounds[:-1][bounds[:-1] < len(raw)]] = True
            start = np.flatnonzero(mark)
            end = np.concatenate([start[1:], [len(raw)]])
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(raw))[: len(raw)], out=sums[1:])
            keys = mix((sums[end] - sums[start]) * powers(INVERSE, len(raw))[start])
            codes, distinct = pd.factorize(keys)
            seen = np.empty(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes))[::-1]
            data = raw.tobytes()
            place = self._places(distinct.tolist(), lambda k: data[start[seen[k]] : end[seen[k]]].decode())
            sizes, starts = self.sizes[place][codes], self.starts[place][codes]
            ends = np.cumsum(sizes)
            ids = self.store[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
            yield first, ids, np.concatenate([[0], ends])[np.searchsorted(start, bounds)]


class Encoder(Remembered):
    """The tokenizers library on a tokenizer file's content."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._forget()  # no method of its own is kept, so an encoder that nobody holds goes at once
        self.model = Tokenizer.from_str(tokenizer_json)
        self.whole = [(t.content.encode(), t.lstrip or t.rstrip or t.single_word) for t in self.model.get_added_tokens_decoder().values()]
        cut = self.model.pre_tokenizer
        bare = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        # nothing but the model works on a word that stands alone
        self.words_alone = bare and self.model.normalizer is None and not any(_WORD(t.decode().strip()) for t, _ in self.whole)

    def _keep_whole(self, raw: np.ndarray, mark: np.ndarray) -> None:
        """The library looks for added tokens before anything else; one that takes in blanks or looks at its neighbours
        is kept together with the blanks around it."""
        data = raw.tobytes()
        for content, wide in filter(lambda t: t[0], self.whole):
            at = data.find(content)
            while at >= 0:
                first, last = at + 1, at + len(content)
                while wide and first > 1 and _BLANK[raw[first - 2]]:
                    first -= 1
                while wide and last < len(raw) and _BLANK[raw[last]]:
                    last += 1
                mark[first - wide : last + wide] = False
                at = data.find(content, at + 1)

    def _batch(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Words go straight to the library's model, other pieces through the whole of it."""
        out: list = [None] * len(pieces)
        words, others = [], []
        for k, p in enumerate(pieces):
            (words if self.words_alone and _WORD(p) else others).append(k)
        for k, ids in zip(others, self._batch([pieces[k] for k in others])):
            out[k] = ids
        if words:
            tokenize, flat, ends = self.model.model.tokenize, [], [0]
            joined = "\n".join([pieces[k] for k in words]).encode().decode("latin-1").translate(_CHARACTERS)
            for word in joined.split(_LINE_END):
                flat += [t.id for t in tokenize(word)]
                ends.append(len(flat))
            ids = np.array(flat, "<u4")
            for k, a, b in zip(words, ends, ends[1:]):
                out[k] = ids[a:b]
        return out


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder of a tokenizer file's content."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def release() -> None:
    """Give back what the worker's encoders hold, pieces and models: where other work follows in the same worker."""
    _encoders.clear()
    give_back()


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def sentence_ends(tokenizer_json: str) -> np.ndarray:
    """Boolean per id: its string ends a sentence or a line."""
    model = encoder(tokenizer_json).model
    pieces = [model.id_to_token(i) or " " for i in range(model.get_vocab_size())]
    return np.array([p[-1] in ".!?Ċ" for p in pieces])
