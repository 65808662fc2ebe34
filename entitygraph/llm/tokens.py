"""Encoding whole texts with a tokenizer file of the ``tokenizers`` library.

A byte-pair tokenizer with a word pre-tokenizer never merges across a word
boundary, so a text's ids are the ids of its white-space delimited pieces in
order ("word": white space never reaches the ids; "byte": a space belongs to
the piece after it).  Pieces repeat, texts do not: a chunk of texts is cut into
pieces, its distinct pieces are found (Arrow dictionary), the library encodes
those that this worker has not met lately, and the ids are gathered piece by
piece.  Pieces that are one word of Latin letters need no normalising or
splitting and go to the library's byte-pair model directly.  An added token of
the file (``<|endoftext|>``) that a text spells out is one id, as the library
gives by default: it is a piece of its own, and what stands before and after it
is cut as texts are.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Unicode White_Space, the set that the tokenizers' patterns call \\s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space beyond ASCII, as characters.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space runs: a piece keeps the single space before it, and of a
#: longer run all but the last character stand alone.
_PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_IS_WS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_IS_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Pieces kept per worker, and the longest piece kept (bytes).
MAX_PIECES = 200_000
MAX_PIECE = 40
#: How byte-level tokenizers write a byte: printable Latin-1 characters stand for
#: themselves, the other bytes follow from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

#: What stands between pieces that are encoded together: it gives one id of its
#: own, which no piece without that character gives.
_BETWEEN = {"byte": ("\n", "\n"), "word": (" 0 ", "0")}
#: Bytes encoded by one call.
CALL_BYTES = 20_000


def _added_tokens(tok, path: str) -> re.Pattern | None:
    """What finds the file's added tokens in a text: leftmost, then longest."""
    added = tok.get_added_tokens_decoder().values()
    for t in added:
        if t.normalized or t.single_word or t.lstrip or t.rstrip:
            raise ValueError(f"{path}: added token {t.content!r} is not found by its text alone")
    longest = sorted((t.content for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None


class Encoder:
    """``encode(texts)`` gives the ids of all texts in one array (without
    special tokens) and the number of ids of each text (null: 0).  ``literal``:
    a special token spelled out in a text is ordinary characters (the library's
    ``encode_special_tokens``)."""

    def __init__(self, path: str, kind: str, width: str = "<u2", *, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = literal
        self._added = None if literal else _added_tokens(self._tok, path)
        self._kind, self._model = kind, self._tok.model
        self.dtype = np.dtype(width)
        if self._tok.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{path}: ids do not fit {width}")
        self._glue, self._mark = _BETWEEN[kind]
        mark = self._ids(self._mark)
        if len(mark) != 1:
            raise ValueError(f"{path}: {self._mark!r} is not one id")
        self._mark_id = mark[0]
        # ids of pieces in two generations: a full young one becomes the old one
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, pieces: list[bytes]) -> None:
        mark, call, size = self._mark.encode(), [], 0
        young, tokenize, byte, code = self._young, self._model.tokenize, self._kind == "byte", self.dtype.char
        for piece in pieces:
            word = piece.decode()
            core = word[1:] if word[0] in " \n" else word
            if core.isalpha() and max(core) < "\u0100" and len(core) < 1000 and not (byte and word[0] == "\n"):
                word = word if byte else core.lower()
                got = tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
                young[piece] = array(code, [t.id for t in got]).tobytes()
                continue
            if mark in piece or len(piece) > CALL_BYTES:
                self._young[piece] = np.array(self._ids(piece.decode()), self.dtype).tobytes()
                continue
            call.append(piece)
            size += len(piece)
            if size >= CALL_BYTES:
                self._call(call)
                call, size = [], 0
        if call:
            self._call(call)

    def _call(self, pieces: list[bytes]) -> None:
        ids = np.array(self._ids(self._glue.encode().join(pieces).decode()), self.dtype)
        ends = np.flatnonzero(ids == self._mark_id)
        if len(ends) != len(pieces) - 1:
            raise AssertionError("the separator of pieces merged with a piece")
        raw, width = ids.tobytes(), self.dtype.itemsize
        a = [0, *((ends + 1) * width).tolist()]
        b = [*(ends * width).tolist(), len(raw)]
        self._young.update(zip(pieces, [raw[i:j] for i, j in zip(a, b)]))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        texts = [t if isinstance(t, str) else "" for t in texts]
        joined = "".join(texts)
        data = joined.encode()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if len(data) != len(joined):
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        ends = np.cumsum(size)
        if self._added is None or not self._added.search(joined):
            return self._gather(data, self._cuts(texts, joined, data, ends), ends)
        # every second part is an added token
        split = [self._added.split(t) for t in texts]
        parts = [p for x in split for p in x]
        upto = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        cuts = self._cuts(parts, joined, data, upto)
        token = np.concatenate([np.arange(len(x)) % 2 == 1 for x in split])
        a, b = np.concatenate([[0], upto[:-1]])[token], upto[token]
        place = np.searchsorted(a, cuts, "left") - 1  # the last token that begins before the cut
        inside = (place >= 0) & (cuts < b[place]) if len(a) else np.zeros(len(cuts), bool)
        return self._gather(data, cuts[~inside], ends)

    def _cuts(self, texts: list[str], joined: str, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Byte offsets at which the texts' pieces begin, and the end."""
        if not data:
            return np.zeros(1, np.int64)
        at = np.frombuffer(data, np.uint8)
        starts = np.zeros(len(at) + 1, bool)
        starts[ends] = True
        starts[0] = True
        starts[:-1] |= (at == 32) | (at == 10)
        # a comma or stop after an ASCII letter begins a piece in both kinds
        starts[1:-1] |= ((at[1:] == 44) | (at[1:] == 46)) & _IS_LETTER[at[:-1]]
        if self._kind == "byte":
            starts[1:] |= at == 10
            white = _IS_WS[at]
            runs = np.flatnonzero(white[1:] & white[:-1]) + 1
            odd = set(np.searchsorted(ends, runs, "right").tolist())
            if any(c in joined for c in _WIDE):
                odd |= {i for i, t in enumerate(texts) if any(c in t for c in _WIDE)}
            for i in odd:  # white space runs here: cut by the pattern
                a, b = int(ends[i - 1]) if i else 0, int(ends[i])
                starts[a + 1:b] = False
                sizes = [len(p.encode()) for p in _PIECE.findall(texts[i])]
                starts[a + np.cumsum(sizes)[:-1].astype(np.int64)] = True
        return np.flatnonzero(starts)

    def _gather(self, data: bytes, cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not data:
            return np.empty(0, self.dtype), np.zeros(len(ends), np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1,
                                                  [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, offsets, values = coded.dictionary.buffers()
        values = values.to_pybytes()
        offsets = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist()
        pieces = [values[i:j] for i, j in zip(offsets, offsets[1:])]
        young, old = self._young, self._old
        got = list(map(young.get, pieces))
        missing = []
        for i in [i for i, x in enumerate(got) if x is None]:
            x = old.get(pieces[i])
            if x is None:
                missing.append(pieces[i])
            else:
                young[pieces[i]] = x
        if missing:
            self._learn(missing)
        got = [young[p] if x is None else x for p, x in zip(pieces, got)]
        if len(young) > MAX_PIECES:
            self._old, self._young = {p: x for p, x in young.items() if len(p) <= MAX_PIECE}, {}
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(got), self.dtype)
        start = (np.cumsum(size) - size)[which]
        size = size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        per_text = np.searchsorted(cuts, ends)
        return ids, np.diff(upto[per_text], prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str, kind: str, width: str = "<u2") -> Encoder:
    """One encoder per worker process and file; added tokens in texts are found."""
    return Encoder(path, kind, width, literal=False)
