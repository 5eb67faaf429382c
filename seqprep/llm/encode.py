"""Token ids of whole texts from a tokenizer file, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from seqprep.llm.common import cached, only_cache

KEPT_BYTES = 20 << 20  # of one generation of the cache; two are held at most
LONGEST = 64  # characters of a word that is kept; longer ones are merged each time
ENTRY = 190  # bytes of an entry besides its characters and ids
MARKED_WORDS = 50_000  # words with a mark behind them that are kept for a while
_MARKS = (",", ".")
_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)
_SHOWN = {c: _BYTES.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}  # as the vocabulary shows them
_PROBE = "The quick, ÀÉßñ über 1234 naïve. fjörð don't ÿþý (x-1):***\"Éa's,'Llb' C3$.5!?"
# What the tokenizer merges apart: lower-cased words of Latin-1 letters, digits and ASCII marks.
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")


def _plain(body: str) -> bool:
    """Letters only, all of them of Latin-1 (and so lower-cased alike by every library)."""
    return body.isalpha() and (body.isascii() or max(body) <= "\xff")


def _pieces(word: str) -> list[str]:
    """The parts that the tokenizer merges apart; none for a word that it has to cut up itself."""
    if _plain(word):
        return [word.lower()]
    if "<|" in word or max(word, default="\u0100") > "\xff":  # may hold a special token, or compose
        return []
    found = _PIECE.findall(word.lower())
    return found if sum(map(len, found)) == len(word) else []


class _Words(dict):
    """Ids of words as bytes, learnt when first met."""

    def __init__(self, tokenizer: Tokenizer, old: dict[str, bytes]):
        super().__init__()
        self._tokenizer, self._model, self._old = tokenizer, tokenizer.model, old
        self.marked: list[str] = []
        self.held = 0  # bytes of the words learnt

    def forget(self) -> None:
        """Let go of the generation before, when this one becomes the old one."""
        self._old = {}

    def _learn(self, word: str) -> bytes:
        """Ids of a word, from the old generation or by merging."""
        if (ids := self._old.get(word)) is None:
            pieces = _pieces(word)
            if len(pieces) == 1:
                shown = pieces[0] if pieces[0].isascii() else pieces[0].translate(_SHOWN)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(shown)])
            elif pieces:
                ids = b"".join([self[piece] for piece in pieces])
            else:
                whole = self._tokenizer.encode(word, add_special_tokens=False).ids
                ids = np.array(whole, dtype="<u4").tobytes()
        if len(word) <= LONGEST:
            self.held += ENTRY + len(ids) + (len(word) if word.isascii() else 4 * len(word))
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        body, mark = word[:-1], word[-1:]
        if mark in _MARKS and len(body) < LONGEST and _plain(body):  # kept for the texts at hand only: too many of them
            ids = (self.get(body) or self._learn(body)) + (self.get(mark) or self._learn(mark))
            self[word] = ids
            self.marked.append(word)
            return ids
        return self._learn(word)


class WordEncoder:
    """Encode texts word by word, with the same ids as encoding them whole.

    Made for a tokenizer that drops white space, lower-cases letters, composes accents and never
    joins characters across white space or letters with marks: a text's ids are then those of its
    parts between spaces and line feeds. Tests compare both ways. Most words of a text have been met
    before, so only new ones are merged. The bytes kept are bounded: when one generation is full, it
    becomes the old one, and only words met again are carried over. A long run without white space (a
    paragraph of a script without spaces, encoded data) is merged anew each time.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._words = _Words(self._tokenizer, {})
        if np.frombuffer(self._one(_PROBE), "<u4").tolist() != self.whole(_PROBE):
            raise ValueError(f"the tokenizer at {path} cannot be applied word by word")

    def whole(self, text: str | None) -> list[int]:
        """The tokenizer's own ids of the text."""
        return self._tokenizer.encode(text or "", add_special_tokens=False).ids

    def _one(self, text: str | None) -> bytes:
        text = text or ""
        try:
            if "<|" not in text:  # else it may hold a special token, which has its own case
                text.encode("latin-1")
                text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; null counts as empty."""
        for text in texts:
            words = self._words
            if len(words.marked) > MARKED_WORDS:
                for word in words.marked:
                    del words[word]
                words.marked.clear()
            if words.held > KEPT_BYTES:
                words.forget()
                self._words = _Words(self._tokenizer, words)
            yield self._one(text)


_ENCODERS: dict[str, WordEncoder] = {}
cached("encode", _ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    """The encoder of this process; Spark's Python workers keep it from task to task."""
    if path not in _ENCODERS:
        only_cache("encode")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
