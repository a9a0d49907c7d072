"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A byte-level BPE works inside pieces that its splitting pattern cuts out, and a
piece never reaches over a space that is followed by something else than white
space: that is a safe boundary.  So a text is cut at such spaces, the words are
looked up in a bounded table, and only unknown pieces go to the library's model.
Whatever does not fit this reasoning (added tokens in the text, unusual white
space, another kind of tokenizer) goes to the library as a whole text.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import unicodedata

import numpy as np

TABLE_BYTES = 80 << 20
"""Bytes of one generation of a worker's table of words; it keeps two, and a quarter of that for parts of words."""

_GAP = re.compile(r" (?=\S)")
_ODD = re.compile("[\0\u0250-\U0010ffff]")
"""Letters whose class may depend on the Unicode version: words with them are left to the library whole."""
_TOGETHER = 64
"""Pieces that the library's model merges in one go: few enough for its queue to stay small, mostly too long for its own table of words."""
_BETWEEN = "\u00c0"
"""Stands between them: the letter of byte 192, which no UTF-8 text has."""
_STOPS = {".", ",", ";", ":", "!", "?"}
"""A sign that is a piece of its own behind letters."""
_SPACE_LIKE = {"Zs", "Zl", "Zp", "Cc", "Cf", "Cn", "Co", "Cs"}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}, 0: "\0"}


_LETTERS = _byte_letters()


class Recent:
    """A table bounded in bytes: two generations, of which the older is dropped when the younger is full.

    Callers read and fill ``young`` directly, and then tell what was ``added``; what
    only the older holds is found by ``take``.
    """

    ENTRY = 150  # object heads of a short text and its value, and their place in the table

    def __init__(self, most_bytes: int):
        self.young: dict = {}
        self.old: dict = {}
        self._bytes, self._most = 0, most_bytes

    def added(self, fresh: dict) -> None:
        """Count entries that were put into ``young``; a full generation becomes the older one."""
        self._bytes += len(fresh) * self.ENTRY + sum(map(len, fresh))
        if fresh and isinstance(next(iter(fresh.values())), bytes):
            self._bytes += sum(map(len, fresh.values()))
        if self._bytes > self._most:
            self.old, self.young, self._bytes = self.young, {}, 0

    def take(self, words: set) -> dict:
        """Those of ``words`` that only the older generation holds."""
        return {w: self.old[w] for w in words & self.old.keys()} if self.old else {}


class PieceEncoder:
    """Ids (or only numbers of ids) of whole texts, equal to the library's own ``encode`` without special tokens."""

    def __init__(self, path: str, lengths_only: bool = False, table_bytes: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import tokenizers

        self._whole = tokenizers.Tokenizer.from_file(path)
        self.vocabulary = self._whole.get_vocab_size(with_added_tokens=True)
        self._lengths_only = lengths_only
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._words, self._pieces = Recent(table_bytes), Recent(table_bytes // 4)
        self._byte_level = self._is_byte_level()
        if self._byte_level:
            import public_tokenizers
            import regex

            self._split = regex.compile(public_tokenizers.PATTERN).findall
            self._model = tokenizers.Tokenizer(self._whole.model)
            lengths = np.zeros(self.vocabulary, np.int64)
            for token, i in self._whole.get_vocab(with_added_tokens=False).items():
                lengths[i] = len(token)
            self._token_letters = lengths
            own = [i for token, i in self._whole.get_vocab(with_added_tokens=False).items() if _BETWEEN in token]
            self._between = own[0] if len(own) == 1 and lengths[own[0]] == 1 else None  # no token that a merge with it would make

    def _is_byte_level(self) -> bool:
        """Only the plain set-up is taken apart: no normalizer, the standard pattern, no added prefix space."""
        state = repr(self._whole.pre_tokenizer)
        return (self._whole.normalizer is None and state.startswith("ByteLevel(") and "add_prefix_space=False" in state
                and "use_regex=True" in state and not getattr(self._whole.model, "ignore_merges", False))

    def forget(self) -> None:
        """Give the tables up."""
        self._words, self._pieces = (Recent(t._most) for t in (self._words, self._pieces))

    def encode(self, texts: list[str]) -> list:
        """One value per text: ids as little-endian unsigned 32-bit bytes, or their number with ``lengths_only``."""
        if not self._byte_level:
            return self._library(texts)
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list:
        known = self._words.young
        parts = [None if any(a in t for a in self._added) else t.split(" ") for t in texts]
        missing = set().union(*filter(None, parts)).difference(known)
        unsafe = set(self._unsafe_of(missing))
        if unsafe:
            for i, (text, words) in enumerate(zip(texts, parts)):
                if words and not unsafe.isdisjoint(words) and not unsafe.isdisjoint(words[1:]):
                    parts[i] = self._cut(text)
            missing = set().union(*filter(None, parts)).difference(known)
        heads = list({p[0] for p in parts if p})
        first = self._of_strings(heads, "")
        fresh = self._words.take(missing)
        fresh.update(self._of_strings([w for w in missing if w not in fresh], " "))
        known.update(fresh)  # all words of the batch are in one table now
        whole = [t for t, p in zip(texts, parts) if p is None]
        rest = iter(self._library(whole) if whole else ())
        value, joined = known.__getitem__, []
        for words in parts:
            if words is None:
                joined.append(next(rest))
                continue
            values = list(map(value, words))
            values[0] = first[words[0]]
            joined.append(sum(values) if self._lengths_only else b"".join(values))
        for w in self._unsafe_of(missing) if unsafe else ():
            del known[w], fresh[w]  # only ever the first word of a text, where no space stands before it
        self._words.added(fresh)
        return joined

    def _library(self, texts: list[str]) -> list:
        found = self._whole.encode_batch_fast(texts, add_special_tokens=False)
        if self._lengths_only:
            return [len(e.ids) for e in found]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    @staticmethod
    def _unsafe(word: str) -> bool:
        """A space before it may belong to a longer run of white space."""
        return not word or word[0].isspace() or word[0] > "\x7f" and unicodedata.category(word[0]) in _SPACE_LIKE

    @classmethod
    def _unsafe_of(cls, words: set[str] | list[str]) -> list[str]:
        return [w for w in words if not "!" <= w[:1] <= "~" and cls._unsafe(w)]

    def _cut(self, text: str) -> list[str] | None:
        """Words of a text with runs of white space; None if a boundary is not surely one for the library."""
        words = _GAP.split(text)
        return None if self._unsafe_of(words[1:]) else words

    def _of_strings(self, words: list[str], before: str) -> dict:
        """Value of each distinct word with what stands before it."""
        values = {}
        if _ODD.search("".join(words)):
            odd = [w for w in words if _ODD.search(w)]
            values = dict(zip(odd, self._library([before + w for w in odd])))
            words = [w for w in words if w not in values]
        # a word of letters is a piece of its own that no table holds: not looked up a second time
        alone = [w for w in words if w.isalpha()]
        values.update(zip(alone, self._made([before + w for w in alone])))
        if len(alone) < len(words):
            split = self._split
            words = [w for w in words if not w.isalpha()]
            cut = [(before + w[:-1], w[-1]) if w[-1:] in _STOPS and w[:-1].isalpha() else split(before + w) for w in words]
            found = self._of_pieces(set().union(*cut), values if before else {}, {c[0] for c in cut if len(c) == 1})
            value = found.__getitem__
            if self._lengths_only:
                values.update(zip(words, [sum(map(value, c)) for c in cut]))
            else:
                values.update(zip(words, [b"".join(map(value, c)) for c in cut]))
        return values

    def _of_pieces(self, pieces: set[str], fresh: dict, words: set[str]) -> dict:
        """Value of each piece.  Whole words are kept by the caller (``fresh``: not in the table yet), so only parts of words are kept here."""
        parts, known = self._pieces, self._words
        found = {}
        for p in pieces:
            v = parts.young.get(p)
            if v is None and p[0] == " ":  # a word seen alone
                v = known.young.get(p[1:])
                if v is None:
                    v = fresh.get(p[1:])
            if v is not None:
                found[p] = v
        found.update(parts.take(pieces - found.keys()))
        new = [p for p in pieces if p not in found]
        if new:
            made = dict(zip(new, self._made(new)))
            found.update(made)
            kept = {p: v for p, v in made.items() if p not in words}
            parts.young.update(kept)
            parts.added(kept)
        return found

    def _made(self, pieces: list[str]) -> list:
        """Value of each piece by the library's model."""
        if not pieces:
            return []
        written = "\0".join(pieces).encode("utf-8").decode("latin-1").translate(_LETTERS).split("\0")
        if self._between is None:
            ids = self._merged(written)
            ends = np.searchsorted(np.cumsum(self._token_letters[ids]), np.cumsum(list(map(len, written)))) + 1
            starts = np.concatenate(([0], ends[:-1]))
        else:
            ids = self._merged([_BETWEEN.join(written[i:i + _TOGETHER]) + _BETWEEN for i in range(0, len(written), _TOGETHER)])
            ends = np.flatnonzero(ids == self._between)
            starts = np.concatenate(([0], ends[:-1] + 1))
        if self._lengths_only:
            return (ends - starts).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    def _merged(self, written: list[str]) -> np.ndarray:
        return np.array(self._model.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")


class SentencePieceEncoder:
    """The same for .model files of the sentencepiece library."""

    def __init__(self, path: str, lengths_only: bool = False):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary, self._lengths_only = self._model.vocab_size(), lengths_only

    def forget(self) -> None:
        """There are no tables."""

    def encode(self, texts: list[str]) -> list:
        found = self._model.encode(texts, num_threads=1)
        return [len(x) for x in found] if self._lengths_only else [np.array(x, dtype="<u4").tobytes() for x in found]


@functools.lru_cache(maxsize=4)
def encoder(path: str, lengths_only: bool = False) -> PieceEncoder | SentencePieceEncoder:
    """One encoder per Python worker, so that its tables serve all tasks the worker runs."""
    return (SentencePieceEncoder if path.endswith(".model") else PieceEncoder)(path, lengths_only)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
