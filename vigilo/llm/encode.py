"""Whole-text encoding with the tokenizers library, with a memo of chunks.

A text is cut only where the tokenizer's own pre-tokenisation always cuts, so the ids of the chunks, one
after another, are the ids of the whole text.  Each worker keeps the ids of chunks it has seen; new chunks
go to the library together.  The memo is bounded; when full it keeps the chunks that came again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: White space other than the single blank or newline, in UTF-8, and the mark of a chunk without a blank; a text
#: that has any takes the slower cut.
RARE_SPACE = [b"\t", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0",
              b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"  ", b" \n", b"\n ", b"\n\n", b"\0"]
RARE_ASCII = [s for s in RARE_SPACE if s.isascii()]
#: Punctuation that the word kind takes as one run behind a word.
PLAIN_ENDS = ".,;:!?"
#: Letters up to this one are letters for Python and the tokenizer alike, and stay so in lower case.
LAST_LATIN = "\u024f"
RUNS = re.compile(r"\s*\S+|\s+")
SEPARATORS = re.compile(r"[\x1c-\x1f]")


class Memo(dict):
    """chunk -> number; unknown chunks get the next number and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """``blank``: the tokenizer keeps a blank as part of the word behind it (byte-level kind); else white
    space is dropped and only divides words.  A chunk is bytes (see ``word``) or a 1-tuple of a string
    to be taken literally."""

    def __init__(self, path: str, blank: bool, memo_chunks: int = 800_000, segment_bytes: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.blank, self.memo_chunks, self.segment_bytes = blank, memo_chunks, segment_bytes
        lead = "\u0120"  # how the byte-level kind writes a blank
        self.marked = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.marked[i] = token.startswith(lead) if blank else token.endswith("</w>")
        self.dtype = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.clear()

    def clear(self) -> None:
        self.memo = Memo()
        self.start, self.size, self.uses = (np.zeros(1 << 12, t) for t in (np.int64, np.int32, np.int32))
        self.flat, self.used = np.zeros(1 << 14, self.dtype), 0

    def learn(self) -> None:
        """Encode the waiting chunks and keep their ids."""
        new, self.memo.new = self.memo.new, []
        first = len(self.memo) - len(new)
        while len(self.memo) > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.uses))
        joined, apart, marks = [], [], []
        for k, chunk in enumerate(new, first):
            word = chunk[0] if isinstance(chunk, tuple) else self.word(chunk.decode())
            n = 0 if isinstance(chunk, tuple) else self.marks(word)
            if n:
                joined.append((k, word))
                marks.append(n)
            else:
                apart.append((k, word))
        for lo in range(0, len(joined), 2000):
            part, each = joined[lo:lo + 2000], np.array(marks[lo:lo + 2000])
            text = ("" if self.blank else " ").join(w for _, w in part)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.marked[ids])
            if len(at) != each.sum():
                apart += part
                continue
            # a mark is the first id of a word with its blank, or the last of a run without white space
            edge = at if self.blank else at[np.cumsum(each) - 1] + 1
            self.keep(np.array([k for k, _ in part]), ids, np.diff(np.append(edge, len(ids))) if self.blank else np.diff(edge, prepend=0))
        for lo in range(0, len(apart), 2000):
            part = apart[lo:lo + 2000]
            got = self.library.encode_batch([[w for _, w in part]], is_pretokenized=True, add_special_tokens=False)[0]
            ids, owner = np.array(got.ids, self.dtype), np.array(got.word_ids, np.int64)
            self.keep(np.array([k for k, _ in part]), ids, np.bincount(owner, minlength=len(part)))

    def keep(self, chunk: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[chunk] = n
        self.start[chunk] = self.used + np.cumsum(n) - n
        self.used += len(ids)

    def marks(self, word: str) -> int:
        """How many marked ids a plain word has; 0 if it isn't plain and must be encoded apart."""
        if self.blank:
            return int(word[:1] == " ")
        body = word.rstrip(PLAIN_ENDS)
        if not body.isalpha() or max(body) > LAST_LATIN or "\u0130" in body:  # that one's lower case is two characters
            return 0
        return 1 + (len(body) < len(word))

    def word(self, chunk: str) -> str:
        """What a chunk stands for: the blank before a word is left out of it, and a mark says there is none."""
        return chunk if not self.blank or chunk == "\n" else chunk[1:] if chunk[:1] == "\0" else f" {chunk}"

    def chunks(self, data: bytes) -> Iterator[list]:
        """The text in bounded lists of chunks."""
        if not self.blank:
            lo = 0
            while lo < len(data):
                hi = data.find(b" ", lo + self.segment_bytes)
                hi = len(data) if hi < 0 else hi
                yield data[lo:hi].split()
                lo = hi
            return
        if any(s in data for s in (RARE_ASCII if data.isascii() else RARE_SPACE)):
            text = data.decode()
            if SEPARATORS.search(text):  # white space for Python, none for the tokenizer
                yield text
                return
            part: list = []
            for m in RUNS.finditer(text):
                part.append((m[0],))
                if len(part) >= 1 << 17:
                    yield part
                    part = []
            yield part
            return
        lo = 0
        while lo < len(data):  # "a b\nc" gives a, b, newline and c, the first and last marked
            hi = data.find(b" ", lo + self.segment_bytes)
            hi = len(data) if hi < 0 else hi
            part = (b"\0" + data[lo:hi] if not lo else data[lo + 1:hi]).replace(b"\n", b" \n \0").split(b" ")
            yield part
            lo = hi

    def encode(self, data: bytes) -> np.ndarray:
        """The ids of one whole text given in UTF-8."""
        return next(self.encode_all([data]))

    def encode_all(self, texts: Iterable[bytes], group_bytes: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of each whole text; texts are looked up in groups of bounded size."""
        waiting: list[list] = []  # of each text: arrays of chunk numbers, or of ids
        size = 0
        for data in texts:
            parts: list = []
            waiting.append(parts)
            for part in self.chunks(data):
                if isinstance(part, str):
                    parts.append((False, np.array(self.library.encode(part, add_special_tokens=False).ids, self.dtype)))
                    continue
                parts.append((True, np.fromiter(map(self.memo.__getitem__, part), np.int32, len(part))))
                size += len(part)
                if size > group_bytes // 8:  # a very long text, or many: replace numbers by ids
                    self.resolve(waiting)
                    size = 0
            if size > group_bytes // 16 or len(waiting) >= 1000:
                self.resolve(waiting)
                size = 0
                yield from map(self.whole, waiting)
                waiting = []
        self.resolve(waiting)
        yield from map(self.whole, waiting)

    def resolve(self, waiting: list[list]) -> None:
        """Replace chunk numbers by ids; afterwards the memo may be thinned."""
        if self.memo.new:
            self.learn()
        numbers = [x for parts in waiting for of_chunks, x in parts if of_chunks]
        if numbers:
            index = np.concatenate(numbers)
            size = self.size[index]
            ends = np.cumsum(size, dtype=np.int64)
            flat = self.flat[np.repeat(self.start[index] - ends + size, size) + np.arange(ends[-1])] if len(ends) else self.flat[:0]
            cut = iter(np.split(flat, np.concatenate([[0], ends])[np.cumsum([len(x) for x in numbers])][:-1]))
            for parts in waiting:
                parts[:] = [(False, next(cut) if of_chunks else x) for of_chunks, x in parts]
            self.uses[:len(self.memo)] += np.bincount(index, minlength=len(self.memo)).astype(np.int32)
        if len(self.memo) > self.memo_chunks:
            self.thin()

    def thin(self) -> None:
        """Keep the chunks that came more than once since the last time."""
        kept = np.flatnonzero(self.uses[:len(self.memo)] > 1)
        if len(kept) > self.memo_chunks // 2:
            kept = kept[:0]
        chunks, start, size, flat = list(self.memo), self.start[kept], self.size[kept].astype(np.int64), self.flat
        self.clear()
        while len(kept) > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.uses))
        for n, k in enumerate(kept.tolist()):
            self.memo[chunks[k]] = n
        ends = np.cumsum(size)
        if len(ends):
            self.keep(np.arange(len(kept)), flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])], size)

    def whole(self, parts: list) -> np.ndarray:
        arrays = [x for _, x in parts]
        return arrays[0] if len(arrays) == 1 else np.concatenate(arrays) if arrays else np.zeros(0, self.dtype)


_KEPT: dict = {}


def encoder(path: str, blank: bool) -> Encoder:
    """This worker's encoder; it stays for the worker's later tasks."""
    if (path, blank) not in _KEPT:
        _KEPT[path, blank] = Encoder(path, blank)
    return _KEPT[path, blank]
