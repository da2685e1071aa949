"""Encoding with the tokenizers library, each distinct piece of text once per worker.

Both vocabularies here split a text before a space that a non-space follows, whatever stands around
it, so the ids of a text are the ids of its space-separated pieces in a row. Natural text repeats its
pieces, and a worker looks most of them up. A text in which a space precedes white space or its end is
encoded whole where white space gives ids. A comma or full stop after a letter and before white space is a piece of its own where white space gives
no ids. New words of Latin letters are one pre-token each and go to the vocabulary's model together, parted by spaces; where their ids part is seen from the ids that
only end (or start) a word. What else there is goes to the model alone, or is encoded piece by piece.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker holds before it starts over; bounds memory, not results.
MAX_PIECES = 500_000
#: Characters encoded at a time: more save look-ups and take memory, some 15 bytes each.
SLICE_CHARS = 2_000_000
#: Characters by byte, as byte-level vocabularies write them: printable ones stand for themselves, the others for those from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TABLE = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


#: Letters of words that are one pre-token for either vocabulary, in lower case too.
_ASCII, _LATIN = "A-Za-z", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"


def lowered(texts: pa.Array) -> pa.Array:
    """Large strings with ASCII letters in lower case, line ends as spaces, and a space between an ASCII letter and a comma or full stop that a space follows. On the bytes: Arrow's own ascii_lower returns wrong bytes for an array that doesn't start
    at the first byte of its buffer, as slices don't."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]].copy() if held and len(texts) else np.zeros(0, np.uint8)
    data[(data >= 65) & (data <= 90)] |= 32
    data[data == 10] = 32
    at = at - at[0]
    if len(data) > 2:
        letter = (data >= 97) & (data <= 122)
        stop = np.flatnonzero(((data[1:-1] == 44) | (data[1:-1] == 46)) & letter[:-2] & (data[2:] == 32)) + 1
        inside = np.searchsorted(at, stop, side="right") - 1
        # The letter and the space are of the same text.
        stop = stop[(at[inside] < stop) & (stop + 1 < at[inside + 1])]
        data = np.insert(data, stop, 32)
        at = at + np.searchsorted(stop, at)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(data)])


class PieceEncoder:
    """drops_space: the vocabulary gives no ids for white space."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.drops_space = drops_space
        self.odd = re.compile(r" \s| $")
        self.bare = Tokenizer(self.model)  # takes words as the model does: written in BYTE_TABLE
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.table = {b: c for b, c in BYTE_TABLE.items() if b != 32}
        vocabulary = self.tok.get_vocab()
        edge = (lambda piece: piece.endswith(self.model.end_of_word_suffix)) if drops_space else (lambda piece: piece.startswith(BYTE_TABLE[32]))
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for piece, i in vocabulary.items() if edge(piece)]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.stops = {c: self.tok.encode(c, add_special_tokens=False).ids for c in ".,"}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _word(self, piece: str) -> list[int] | None:
        """Ids of a piece that is a word of plain letters, perhaps with a stop; None if it is not."""
        stop = piece[-1:] if piece[-1:] in self.stops else ""
        word = piece[:-1] if stop else piece
        bare = word if self.drops_space else word.removeprefix(" ")
        if not bare.isalpha() or max(bare) >= "\u0250":
            return None
        mapped = bare
        if self.drops_space:
            mapped = bare.lower()
            if not mapped.isalpha():
                return None
        if not mapped.isascii():
            mapped = mapped.encode().decode("latin-1").translate(BYTE_TABLE)
        ids = [t.id for t in self.model.tokenize(mapped if len(word) == len(bare) else BYTE_TABLE[32] + mapped)]
        return ids + self.stops[stop] if stop else ids

    def _words(self, words: list[str], ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, in a row, and how many each has."""
        text = " ".join(words) if self.drops_space else "".join(words)
        if self.drops_space:
            text = text.lower()
        if not ascii_only:
            text = text.encode().decode("latin-1").translate(self.table)
        if not self.drops_space:
            text = text.replace(" ", " " + BYTE_TABLE[32])
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        return ids, np.diff(np.concatenate([[-1], edges])) if self.drops_space else np.diff(np.append(edges, len(ids)))

    def _add(self, strings: list[str]) -> np.ndarray:
        """Encodes the strings; their entry numbers."""
        at = np.arange(self.n, self.n + len(strings))
        held = pa.array(strings, pa.large_string())
        latin = np.zeros(len(strings), bool)
        for letters in (_ASCII, _LATIN):
            like = pc.match_substring_regex(held, f"^{'' if self.drops_space else ' '}[{letters}]+$").to_numpy(zero_copy_only=False).astype(bool) & ~latin
            some = np.flatnonzero(like)
            if len(some):
                self._keep(at[some], *self._words([strings[i] for i in some.tolist()], letters == _ASCII))
            latin |= like
        rest = np.flatnonzero(~latin).tolist()
        out = [self._word(strings[i]) for i in rest]
        hard = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(hard, self.tok.encode_batch_fast([strings[rest[k]] for k in hard], add_special_tokens=False)):
            out[k] = e.ids
        lens = np.fromiter(map(len, out), np.int64, len(out))
        self._keep(at[rest], np.fromiter(chain.from_iterable(out), np.uint32, int(lens.sum())), lens)
        return at

    def _keep(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Holds the ids of entries at."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(at) and at[-1] >= len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(lens) - lens
        self.length[at] = lens
        self.used, self.n = self.used + len(ids), self.n + len(at)

    def _entries(self, strings: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = list(dict.fromkeys(strings[i] for i in missing))
            self.known.update(zip(new, self._add(new).tolist()))
            for i in missing.tolist():
                out[i] = self.known[strings[i]]
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MAX_PIECES:
            self._reset()
        if self.drops_space:  # such a vocabulary lowers letters, and any white space parts its words
            texts = lowered(texts)
            whole = np.zeros(0, np.int64)
        else:
            plain = texts.to_pylist()
            odd = [self.odd.search(t) is not None for t in plain]
            whole = np.flatnonzero(odd)
            texts = pc.if_else(pa.array(odd, pa.bool_()), "", texts)
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        values = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        if self.drops_space:
            entry = self._entries(values)[codes]
        else:
            first = at[:-1]
            entry = self._entries([" " + v for v in values])[codes]
            entry[first] = self._entries([values[c] for c in codes[first]])
        if len(whole):
            entry[at[whole]] = self._add([plain[i] for i in whole])
        lens = self.length[entry]
        ends = np.cumsum(lens)
        if not len(ends):
            return self.ids[:0], np.zeros(len(texts), np.int64)
        from_at = np.repeat((self.start[entry] - ends + lens).astype(np.int32), lens)
        from_at += np.arange(ends[-1], dtype=np.int32)
        return self.ids[from_at], np.diff(np.concatenate([[0], ends])[at])

    def encode(self, texts: pa.Array, chars: int | None = None):
        """Yields the ids of each text; about so many characters are encoded at a time."""
        chars = chars or SLICE_CHARS
        texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
        size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars)))
            ids, lens = self._slice(texts.slice(at, to - at))
            ends = np.cumsum(lens)
            for a, b in zip((ends - lens).tolist(), ends.tolist()):
                yield ids[a:b]
            at = to


@functools.lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> PieceEncoder:
    """One per worker process."""
    return PieceEncoder(path, drops_space)
