"""Fast exact encoding with public tokenizers inside Spark tasks.

Most words of a corpus repeat, so each worker encodes a distinct word once and keeps the result in
a bounded cache. Texts with characters whose handling could differ between Python and the
tokenizer's own normaliser go to the library word by word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words `[^\x20\x09-\x0D]+` as all operators here take them.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Entries after which a worker's cache starts anew; bounds memory, not results.
CACHE_WORDS = 500_000
#: Characters of text that are split into words at a time.
SLICE_CHARS = 1_000_000


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters; null is the empty text."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 characters
    stand for themselves, the others for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def to_byte_letters(text: str, keep: str = "") -> str:
    """``text`` as a byte-level vocabulary spells it; the ASCII characters in ``keep`` stay."""
    letters = byte_letters()
    if keep:
        letters = letters | {ord(c): c for c in keep}
    return text.encode().decode("latin-1").translate(letters)


_resident: dict = {}


def resident(key: tuple, make):
    """``make()``, kept for later tasks of this worker until another object is asked for, so that a
    worker which serves several operators holds the caches of one of them only."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _uncached(tokenizer):
    """The model's own small cache only costs time when every word comes once."""
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)
    return tokenizer


class WordBpe:
    """Ids of whole texts for a lower-casing vocabulary with word ends, as little-endian bytes.

    No token of such a vocabulary spans white space, so the ids of a text are those of its words.
    """

    #: Pre-tokens of the vocabulary file, with its white space written out for Latin-1.
    _PIECES = regex.compile(
        r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")
    _SUFFIX = "</w>"
    _MARKS = ".,;:!?"
    #: Where ``str.split`` sees white space and the vocabulary's pattern does not.
    _CONTROLS = re.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = load(path)
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(self._SUFFIX)]] = True
        self._special = [str(t) for t in
                         (a.content for a in self.library.get_added_tokens_decoder().values())]
        self._merges = _uncached(Tokenizer(self.library.model))
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._limit = cache_words
        self._marks = {m: np.array(e.ids, dtype=self.dtype).tobytes() for m, e in
                       zip(self._MARKS, self.library.encode_batch(list(self._MARKS),
                                                                  add_special_tokens=False))}
        self._latin: dict[str, bytes] = {}
        self._other: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Give texts in slices: their words are held together."""
        plain: list[list[str] | None] = []
        words: list[list[str]] = []
        for text in texts:
            simple = is_latin1(text) and not any(s in text for s in self._special)
            plain.append(simple)
            if not simple:
                words.append(WORD.findall(text))
            elif self._CONTROLS.search(text):
                words.append(WORD.findall(text.lower()))
            else:
                words.append(text.lower().split())
        for cache, learn, chosen in ((self._latin, self._learn_latin, True),
                                     (self._other, self._learn_other, False)):
            seen = set().union(*(w for w, p in zip(words, plain) if p is chosen))
            if len(cache) + len(seen) > self._limit:
                cache.clear()
            learn(list(seen.difference(cache)))
        return [b"".join(map((self._latin if p else self._other).__getitem__, w))
                for w, p in zip(words, plain)]

    def _learn_latin(self, new: list[str]) -> None:
        """Plain words are one pre-token; a mark behind a plain word is another one."""
        known = self._latin
        plain, marked, others = set(), [], []
        for word in new:
            if word.isalpha():
                plain.add(word)
            elif word[-1] in self._MARKS and word[:-1].isalpha():
                marked.append(word)
                if word[:-1] not in known:
                    plain.add(word[:-1])
            else:
                others.append(word)
        self._merge(list(plain), list(plain), None)
        if others:
            pieces = self._PIECES.findall("\n".join(others))
            is_break = np.fromiter((p == "\n" for p in pieces), dtype=bool, count=len(pieces))
            self._merge(others, [p for p in pieces if p != "\n"],
                        np.flatnonzero(is_break) - np.arange(len(others) - 1))
        for word in marked:
            known[word] = known[word[:-1]] + self._marks[word[-1]]

    def _merge(self, words: list[str], pieces: list[str], pieces_before: np.ndarray | None) -> None:
        """Caches the ids of ``words``, whose pre-tokens follow one another in ``pieces``: one each,
        or as many in front of each word but the first as ``pieces_before`` says."""
        if not words:
            return
        letters = [to_byte_letters(" ".join(pieces[i:i + 200]), keep=" ")
                   for i in range(0, len(pieces), 200)]
        found = self._merges.encode_batch_fast(letters, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in found]
                             or [np.zeros(0, dtype=self.dtype)])
        cuts = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        if pieces_before is not None:
            cuts = np.concatenate([[0], cuts[pieces_before], [len(ids)]])
        data, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        self._latin.update((w, data[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def _learn_other(self, new: list[str]) -> None:
        if new:
            found = self.library.encode_batch_fast(new, add_special_tokens=False)
            self._other.update((w, np.array(e.ids, dtype=self.dtype).tobytes())
                               for w, e in zip(new, found))


class TokenCounter:
    """Number of tokens of whole texts for a byte-level vocabulary.

    A pre-token that is itself a whole token (see ``whole_tokens``) counts one without merging.
    """

    _WHITE = r"\t-\r \x85\xa0  -     　"
    _CHUNKS = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
    _PIECES = regex.compile(
        rf"\n|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+")

    #: What parts words otherwise than by one blank or line break.
    _UNEVEN = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0]| [ \n]|\n[ \n]|\A[ \n]|[ \n]\Z")

    def __init__(self, path: str, whole: frozenset[str], cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = load(path)
        self._special = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self._merges = _uncached(Tokenizer(self.library.model))
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self._lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self._lengths[i] = len(token)
        self._whole = whole
        self._limit = cache_words
        self._counts = dict.fromkeys(whole, 1)
        self._pieces: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words parted by single blanks and line breaks are told apart by a plain
        split: the pieces between are " word" in the text, or with a line break in front "\\nword"."""
        parts: list[tuple[bool, int, list[str]]] = []
        for text in texts:
            special = sum(map(text.count, self._special)) if "<|" in text else 0
            if not special and text and is_latin1(text) and not self._UNEVEN.search(text):
                parts.append((True, 0, text.replace("\n", " \n").split(" ")))
            elif special:
                between = re.split("|".join(map(re.escape, self._special)), text)
                parts.append((False, len(between) - 1, [c for p in between for c in self._CHUNKS.findall(p)]))
            else:
                parts.append((False, 0, self._CHUNKS.findall(text)))
        firsts = {p[2][0] for p in parts if p[0]}
        chunks = firsts.union(*(p[2] for p in parts if not p[0]))
        pieces = set().union(*(p[2][1:] for p in parts if p[0]))
        if len(self._counts) + len(self._pieces) + len(pieces) + len(chunks) > self._limit + len(self._whole):
            self._counts, self._pieces = dict.fromkeys(self._whole, 1), {}
        new = pieces.difference(self._pieces)
        asked = {p: p[1:] if p[0] == "\n" else " " + p for p in new}
        wanted = {c for c in asked.values() if c}
        learned = self._learn([c for c in wanted if c not in self._whole])
        self._pieces.update((p, (p[0] == "\n") + (learned.get(c, 1) if c else 0)) for p, c in asked.items())
        self._counts.update(self._learn(list(chunks.difference(self._counts))))
        piece, chunk = self._pieces.__getitem__, self._counts.__getitem__
        return [chunk(p[0]) + sum(map(piece, p[1:])) if even else n + sum(map(chunk, p))
                for even, n, p in parts]

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Tokens of chunks: pre-tokens found whole count one, the rest are merged together."""
        result: dict[str, int] = {}
        words, others = [], []
        for chunk in new:
            (words if is_latin1(chunk) and not chunk.isspace() else others).append(chunk)
        if others:
            found = self.library.encode_batch_fast(others, add_special_tokens=False)
            result.update((c, len(e.ids)) for c, e in zip(others, found))
        if not words:
            return result
        pieces = self._PIECES.findall("\n".join(words))
        whole, owner, counts = self._whole, 0, [0] * len(words)
        rest, owners = [], []
        for piece in pieces:
            if piece == "\n":
                owner += 1
            elif piece in whole:
                counts[owner] += 1
            else:
                rest.append(piece)
                owners.append(owner)
        for owner, n in zip(owners, self._merged(rest)):
            counts[owner] += n
        result.update(zip(words, counts))
        return result

    def _merged(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token. Many are merged at a time; as tokens are spelled with the letters
        of their pre-token, running lengths tell which belong to which."""
        if not pieces:
            return []
        joined = [to_byte_letters("\n".join(pieces[i:i + 200]), keep="\n") for i in range(0, len(pieces), 200)]
        found = self._merges.encode_batch_fast(joined, add_special_tokens=False)
        ends = np.cumsum(self._lengths[np.concatenate([np.array(e.ids, dtype=np.int64) for e in found])])
        lengths = [len(p) for part in joined for p in part.split("\n")]
        return np.diff(np.searchsorted(ends, np.cumsum(lengths)) + 1, prepend=0).tolist()


def whole_tokens(path: str) -> frozenset[str]:
    """Strings of a byte-level vocabulary that the library encodes, alone, as one token.

    Tokens that are no valid text or that a merge order never reaches are left out: each string
    is encoded once here and kept only if its own id comes back.
    """
    library = load(path)
    letters = {c: b for b, c in byte_letters().items()}
    special = {a.content for a in library.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for token, i in library.get_vocab().items():
        if token in special:
            continue
        try:
            texts.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
        ids.append(i)
    found = library.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found) if e.ids == [i])
