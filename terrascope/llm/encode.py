"""Exact, cached encoding with a byte-level BPE file of the tokenizers library.

Byte-level BPE merges only inside a pre-token, so the ids of a text are the ids
of its pre-tokens in order.  The text is cut at places that are pre-token
starts whatever surrounds them: a single space between two visible characters,
before and after a single newline between two visible characters, and where an
ASCII sign follows a letter.  "Visible" and "letter" are judged for ASCII and
the Latin-1 letters only; elsewhere no cut is made, which is always right.  Nor is
one made inside the string of an added token (``<|endoftext|>``), which the tokenizer
turns into one id wherever it stands.

The parts repeat (words), so their ids are kept in a bounded table looked up by
64-bit hash for a whole slice of texts at once; only parts not seen before go
through the tokenizer, many in one call.  Two different parts share a hash with
probability 2**-64.
"""

from __future__ import annotations

import os
import re

import numpy as np

from terrascope.llm.textvec import _CHAR, _grow, _powers, mix

_VISIBLE, _LETTER, _SIGN = (np.zeros(256, dtype=bool) for _ in range(3))
_VISIBLE[33:127] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[33:127] = True
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LATIN = np.zeros(256, dtype=bool)  # second bytes of Latin-1 letters
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SPACE, _LINE = 0x20, 0x0A
_OTHER_WHITE = re.compile(r"[^\S \n]")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The process-wide encoder of a tokenizer file (its table survives tasks)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted start positions of the parts of every text in ``data``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    latin = np.zeros(n, dtype=bool)  # at the second byte of a Latin-1 letter
    latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    ends_visible = _VISIBLE[data] | latin
    starts_visible = _VISIBLE[data]
    starts_visible[:-1] |= latin[1:]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    gap = np.zeros(n, dtype=bool)  # a lone white byte between visible characters of one text
    gap[1:-1] = ends_visible[:-2] & starts_visible[2:] & ~first[1:n - 1] & ~first[2:n]
    line = gap & (data == _LINE)
    begin = gap & (data == _SPACE) | line
    begin[1:] |= line[:-1]
    begin[1:] |= (_LETTER[data[:-1]] | latin[:-1]) & _SIGN[data[1:]]
    begin |= first[:n]
    return np.flatnonzero(begin)


class Encoder:
    """Texts to ids.  ``max_entries`` bounds the table; when full it is emptied."""

    def __init__(self, path: str, max_entries: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values() if t.content]
        self._max = max_entries
        self._line = self._tok.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self._hash = np.zeros(0, dtype=np.uint64)
        self._at = np.zeros(0, dtype=np.int64)
        self._len = np.zeros(0, dtype=np.int64)
        self._flat = np.zeros(0, dtype=np.uint32)

    @property
    def vocab_size(self) -> int:
        """Number of ids, special ones included."""
        return self._tok.get_vocab_size(with_added_tokens=True)

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of parts.  A newline between two parts is one
        pre-token and one id, so many parts are encoded as one text and cut at
        that id; where a part holds other white space, one by one."""
        lengths, flats = [], []
        for a in range(0, len(parts), 500):
            group = parts[a:a + 500]
            text = b"\n".join(group).decode()
            plain = (not any(t in text for t in self._added) and len(self._line) == 1 and text.count("\n") == len(group) - 1 and "  " not in text
                     and " \n" not in text and text[-1:] != " " and not _OTHER_WHITE.search(text))
            if plain:
                x = np.asarray(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                mark = np.flatnonzero(x == self._line[0])
                plain = len(mark) == len(group) - 1
            if plain:
                flats.append(x[x != self._line[0]])
                lengths.append(np.diff(mark, prepend=-1, append=len(x)) - 1)
            else:
                one = self._tok.encode_batch_fast([p.decode() for p in group], add_special_tokens=False)
                one = [np.asarray(e.ids, dtype=np.uint32) for e in one]
                flats.extend(one)
                lengths.append(np.array([len(p) for p in one], dtype=np.int64))
        return np.concatenate(flats), np.concatenate(lengths)

    def _parts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """``cuts``, without those inside the string of an added token."""
        start = cuts(data, offs)
        raw = data.tobytes()
        for token in self._added:
            word = token.encode()
            at = raw.find(word)
            while at >= 0:
                a, b = np.searchsorted(start, [at + 1, at + len(word)])
                inner = start[a:b]
                text = np.searchsorted(offs, at, side="right")
                if offs[text] < at + len(word):       # it reaches into the next text: none
                    at = raw.find(word, at + 1)
                    continue
                if len(inner):
                    start = np.delete(start, slice(a, b))
                at = raw.find(word, at + len(word))
        return start

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of the texts of a slice (see ``text_slices``):
        text ``d`` has the ids ``ids[bounds[d]:bounds[d+1]]`` (unsigned 32 bit)."""
        start = self._parts(data, offs)
        if len(start) == 0:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64)
        end = np.append(start[1:], len(data))
        n = len(data)
        _grow(n + 1)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CHAR[data] * _powers["up"][:n], out=run[1:])
        h = mix((run[end] - run[start]) * _powers["down"][start] + (end - start).astype(np.uint64))
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self._hash) + len(kinds) > self._max:
            self._clear()
        at = np.searchsorted(self._hash, kinds)
        known = np.zeros(len(kinds), dtype=bool)
        inside = at < len(self._hash)
        known[inside] = self._hash[at[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            flat, lengths = self._encode_parts([raw[a:b] for a, b in zip(s, e)])
            base = len(self._flat)
            where = at[new]
            self._hash = np.insert(self._hash, where, kinds[new])
            self._at = np.insert(self._at, where, base + np.cumsum(lengths) - lengths)
            self._len = np.insert(self._len, where, lengths)
            self._flat = np.concatenate((self._flat, flat))
            at = np.searchsorted(self._hash, kinds)
        part = at[which]
        lengths = self._len[part]
        edge = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum(lengths, out=edge[1:])
        ids = self._flat[np.repeat(self._at[part] - edge[:-1], lengths) + np.arange(edge[-1])]
        return ids, edge[np.searchsorted(start, offs)]
