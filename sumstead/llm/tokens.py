"""Token ids and counts of whole texts, each distinct stretch between blanks encoded once per task.

Both libraries are exact when a text is cut at the places used here: the word
vocabulary drops white space before it merges anything, and no piece of the
sentence vocabulary has a blank behind another character.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from sumstead.llm.common import safe_segments

REMEMBERED = 400_000
SEGMENT_CHARS = 1 << 20
WORDS_TOGETHER = 2000
WORD_END = "</w>"
_BLANK = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
#: Letters that the vocabulary's lower case maps one to one, then a run of marks; both are encoded apart.
_WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def remember(known: dict, stretches: set[str], values: Callable[[list[str]], list]) -> None:
    """Adds what is not known; forgets all of it first when there is too much."""
    if len(known) > REMEMBERED:
        known.clear()
    new = [s for s in stretches if s not in known]
    if new:
        known.update(zip(new, values(new), strict=True))


class _Memory:
    """Values of stretches, found once while they are remembered."""

    def __init__(self) -> None:
        self.known: dict = {}

    def learn(self, stretches: set[str]) -> None:
        remember(self.known, stretches, self.values)

    def values(self, stretches: list[str]) -> list:
        raise NotImplementedError


class WordIds(_Memory):
    """Ids of a ``tokenizers`` file whose pre-tokenizer drops white space."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def values(self, stretches: list[str]) -> list[bytes]:
        """A word with marks behind it is two stretches; words differ in case only here."""
        parts = [_WORD_AND_MARKS.fullmatch(s) for s in stretches]
        words = {m[1].lower() for m in parts if m} | {m[2] for m in parts if m and m[2]}
        remember(self.plain, words, self.whole_words)
        others = iter(self.ids_of([s for s, m in zip(stretches, parts, strict=True) if not m]))
        return [self.plain[m[1].lower()] + self.plain.get(m[2], b"") if m else next(others) for m in parts]

    def ids_of(self, stretches: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(stretches, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def whole_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the pre-tokenizer keeps whole: encoded together, cut behind each word's last token."""
        found = []
        for start in range(0, len(words), WORDS_TOGETHER):
            some = words[start : start + WORDS_TOGETHER]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = [0, *((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()]
            if len(ends) != len(some) + 1:
                raise ValueError("the vocabulary doesn't mark the end of each word")
            data = ids.tobytes()
            found += [data[a:b] for a, b in itertools.pairwise(ends)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        found = []
        for text in texts:
            parts = []
            for segment in safe_segments(text, SEGMENT_CHARS):
                words = segment.replace("\n", " ").split(" ")
                try:
                    parts.append(b"".join(map(self.known.__getitem__, words)))
                except KeyError:
                    self.learn(set(words))
                    parts.append(b"".join(map(self.known.__getitem__, words)))
            found.append(b"".join(parts))
        return found


class PieceCounts(_Memory):
    """Numbers of pieces of a ``sentencepiece`` model that starts texts with a blank."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def values(self, stretches: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(stretches, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        found = []
        for text in texts:
            total = 0
            for n, segment in enumerate(safe_segments(text, SEGMENT_CHARS)):
                # The blank that a later segment starts with is the one the library puts in front.
                words = _BLANK.split(segment[1:] if n else segment)
                try:
                    total += sum(map(self.known.__getitem__, words))
                except KeyError:
                    self.learn(set(words))
                    total += sum(map(self.known.__getitem__, words))
            found.append(total)
        return found


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One encoder per worker process."""
    return WordIds(path)


@lru_cache(maxsize=4)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
