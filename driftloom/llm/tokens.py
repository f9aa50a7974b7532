"""Token ids by a public tokenizer, one word at a time behind a bounded cache.

The tokenizer drops white space and splits at it before anything else, so a text's ids are the ids of its words in order
(``tests/llm`` holds this against whole texts). Words repeat; each worker keeps the ids of those it met, and gives only
new ones to the library.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import os
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: The id that ends each document.
END = 2
#: Words that a worker's cache holds before it starts afresh.
CACHED_WORDS = 700_000
#: Words, of those met first, that it keeps then and from task to task; idle workers hold no more.
KEPT_WORDS = 100_000
VOCABULARY = "word_bpe_49k.json"


def default_path() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Letters below this one lower-case alike everywhere and are never changed by normal form C.
_PLAIN_END = "\u0250"


def _byte_letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, others from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


_BYTE_LETTERS = _byte_letters()
#: Characters of new words that the library gets in one string.
_TOGETHER = 32_768


class _Known(dict):
    """Ids of words. One that is looked up for the first time is learnt, and so are its core and its marks, which are words themselves."""

    def __init__(self, cut: Callable[[bytes], tuple[bytes, bytes]], ids: Callable[[bytes], bytes]):
        super().__init__()
        self.cut, self.ids = cut, ids

    def __missing__(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters alone
            found = self.ids(w) if w.islower() else self[w.lower()]
        else:
            core, marks = self.cut(w)
            found = self.ids(w) if core == w else self[core] + self[marks] if marks else self[core]
        self[w] = found
        return found


class WordEncoder:
    """Encodes texts given as UTF-8 bytes. ``path`` is the tokenizer's file; null looks it up on the worker."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenize = self.tokenizer.model.tokenize
        self.known = _Known(self._core, self._ids)
        self.spans: dict[bytes, bytes] = {}
        self.part_spans: dict[bytes, tuple[list[int], int]] = {}

    def _library(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and code-point spans of words. They go to the library in long strings; offsets tell the words apart."""
        at = 0
        while at < len(words):
            texts, size = [], 0
            while at < len(words) and size < _TOGETHER:
                texts.append(words[at].decode())
                size += len(texts[-1]) + 1
                at += 1
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids, spans = np.array(found.ids, "<u4"), np.array(found.offsets, np.int64).reshape(-1, 2)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            edges = np.searchsorted(spans[:, 0], starts)
            for k, start in enumerate(starts[:-1]):
                own = slice(edges[k], edges[k + 1])
                yield ids[own], spans[own] - start

    def _core(self, w: bytes) -> tuple[bytes, bytes]:
        """A word as a lower-case core and trailing marks that the library encodes apart, or the word whole.

        The library splits between a letter and a mark other than the apostrophe, and lower-cases letters one by one;
        for the letters below ``_PLAIN_END`` that is what ``lower`` does.
        """
        if b"<|" in w:  # may hold a special token, which the library seeks before it lower-cases
            return w, b""
        core = w.rstrip(b".,!?%$*&#|")
        if w.isascii():
            return (core.lower(), w[len(core) :]) if core and core[-1:].isalpha() else (w.lower(), b"")
        letters = core.decode()
        if letters.isalpha() and max(letters) < _PLAIN_END and "\u0130" not in letters:
            return letters.lower().encode(), w[len(core) :]
        return w, b""

    def _ids(self, part: bytes) -> bytes:
        """Ids of a core or of marks. Lower-case letters alone are one pre-token as they are, so the library's model takes
        them at once; all else goes through the whole tokenizer."""
        if part.isalpha() and part.islower():
            ids = [t.id for t in self.tokenize(part.decode())]
        elif (letters := part.decode()).isalpha() and letters.islower() and max(letters) < _PLAIN_END:
            ids = [t.id for t in self.tokenize("".join(map(_BYTE_LETTERS.__getitem__, part)))]
        else:
            ids = self.tokenizer.encode(letters, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers, with ``END`` last."""
        find, end, out = self.known.__getitem__, np.array([END], "<u4").tobytes(), []
        for text in texts:
            if len(self.known) > CACHED_WORDS:
                self.trim()
            out.append(np.frombuffer(b"".join([*map(find, text.split()), end]), "<u4"))
        return out

    def trim(self) -> None:
        """Gives up most of the caches. Frequent words are met early, so the first ones are the ones worth keeping."""
        kept = list(itertools.islice(self.known.items(), KEPT_WORDS))
        self.known.clear()
        self.known.update(kept)
        self.spans.clear()
        self.part_spans.clear()

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token of a text, in code points of the text; the end id has none."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(text, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.flatnonzero(~space & np.r_[True, space[:-1]])
        chars = np.cumsum((data & 0xC0) != 0x80) - 1
        own = list(map(self.spans.__getitem__, words))
        spans = np.frombuffer(b"".join(own), "<i4").reshape(-1, 2)
        shift = np.repeat(chars[first], np.fromiter(map(len, own), np.int64, len(own)) >> 3)
        return spans[:, 0] + shift, spans[:, 1] + shift

    def _part_spans(self, parts: list[bytes]) -> Iterator[tuple[bytes, tuple[list[int], int]]]:
        """Starts and ends of the tokens of cores and marks, in turn, and their length in code points."""
        model, others = self.tokenizer.model, []
        for part in parts:
            letters = part.decode()
            if part.isalpha() and part.islower():
                yield part, ([x for t in model.tokenize(letters) for x in t.offsets], len(letters))
            elif letters.isalpha() and letters.islower() and max(letters) < _PLAIN_END:
                # offsets count bytes of the spelled word, whose letters stand for bytes of this one; a token takes each
                # code point that it has a byte of
                chars = [k for k, c in enumerate(letters) for b in c.encode() for _ in _BYTE_LETTERS[b].encode()]
                tokens = model.tokenize("".join(map(_BYTE_LETTERS.__getitem__, part)))
                yield part, ([x for t in tokens for x in (chars[t.offsets[0]], chars[t.offsets[1] - 1] + 1)], len(letters))
            else:
                others.append(part)
        for part, (_, spans) in zip(others, self._library(others), strict=True):
            yield part, (spans.ravel().tolist(), len(part.decode()))

    def learn_places(self, texts: list[bytes]) -> None:
        """Makes the spans of all words of some texts known, which ``places`` reads."""
        if len(self.spans) > CACHED_WORDS:
            self.spans.clear()
            self.part_spans.clear()
        fresh = set().union(*(t.split() for t in texts)).difference(self.spans) if texts else set()
        cut, known = [(w, *self._core(w)) for w in fresh], self.part_spans
        known.setdefault(b"", ([], 0))
        known.update(self._part_spans(list({c for _, c, _ in cut}.union(m for _, _, m in cut).difference(known))))
        for w, core, marks in cut:
            (flat, size), (rest, _) = known[core], known[marks]
            self.spans[w] = array("i", [*flat, *(x + size for x in rest)]).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


@contextlib.contextmanager
def task_encoder(path: str | None = None) -> Iterator[WordEncoder]:
    """The worker's encoder for one task. A worker outlives its tasks, idle beside those of other stages, so the caches are trimmed at the end."""
    own = encoder(path)
    try:
        yield own
    finally:
        own.trim()
