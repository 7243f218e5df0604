"""Token ids of whole texts with a given public tokenizer.

A tokenizer splits a text into pieces before it looks for merges, and a piece always gets the same
ids. An ``Encoder`` cuts texts at white space, and letters from ASCII punctuation, looks the pieces
up among those it keeps, asks the tokenizer once for the new ones of many texts, and keeps short
pieces up to a number of bytes. New pieces of letters alone go to the tokenizer's own model, without
its search for pieces. Texts with white space other than blank, tab and line ends, or with the mark of
a special token, are encoded whole. A worker keeps one encoder, until another operator keeps
something there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np

from .common import kept

KEPT_BYTES = 64 << 20       # of pieces with their ids, overhead included
ENTRY = 180                 # bytes that a kept piece takes beside its text and ids
LONGEST = 64                # characters of a word or piece that is kept
TOGETHER = 1 << 20          # characters of texts that are encoded together

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
END = r"(?=[ \n\t\r!-&(-/:-@\[-`{-~]|\Z)"
# Letters end at ASCII punctuation (but for the apostrophe of contractions), so that "word," and
# "word." share a piece.
PIECE = re.compile(rf" ?[{LETTER}]+{END}| ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
# the same for tokenizers that drop white space
WORD = re.compile(rf"[{LETTER}]+{END}|[^ \n\t\r]+")
LETTERS = re.compile(rf" ?[{LETTER}]+").fullmatch
# white space beyond blank, tab and line ends: one byte of it in UTF-8, or the first of several
ODD_BYTES = bytes(set(range(256)) - {0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3})
ODD = re.compile(r"[^\S \n\t\r]")
MARK = "\x01"


def whole(text: str) -> bool:
    """Whether a text must not be cut."""
    return "<|" in text or bool(text.encode().translate(None, ODD_BYTES) and ODD.search(text))


class Encoder:
    """Ids as little-endian unsigned integers of ``width`` bytes, by tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known, self.size = {}, 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        # lower case and white space do not count: fold them before a piece is looked up
        self.folds = normal == ["NFC", "Replace", "Lowercase"] and bool(suffix)
        # the model alone, for pieces of letters that a mark keeps apart
        self.model = None
        bare = spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") is True
        if self.folds or bare:
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = None
            self.model.pre_tokenizer = Sequence([
                CharDelimiterSplit(MARK), ByteLevel(add_prefix_space=False, use_regex=False)])
            # bytes that each id stands for
            self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes[i] = len(token) - len(suffix or "") * token.endswith(suffix or "\0")

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_model(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters, asked for in texts of a hundred; bytes tell them apart."""
        texts = [MARK.join(pieces[s:s + 100]) for s in range(0, len(pieces), 100)]
        ids = np.array([i for e in self.model.encode_batch_fast(texts, add_special_tokens=False)
                        for i in e.ids], self.kind)
        ends = np.cumsum([len(p.encode()) for p in pieces])
        upto = np.cumsum(self.bytes[ids])
        cuts = np.searchsorted(upto, ends) + 1
        if not len(ids) or cuts[-1] != len(ids) or (upto[cuts - 1] != ends).any():
            return self._ask(pieces)
        data, cuts = ids.tobytes(), (cuts * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a text; None if it must not be cut."""
        if whole(text):
            return None
        if self.folds:
            try:        # in Latin-1, lower case is a matter of single characters
                text = text.encode("latin-1").decode("latin-1").lower()
            except UnicodeEncodeError:
                pass
            return WORD.findall(text)
        return PIECE.findall(text)

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces that were not known; short ones are kept."""
        new, letters, rest = {}, [], []
        if self.model is None:
            rest = list(missing)
        else:
            for p in missing:
                (letters if LETTERS(p) else rest).append(p)
        for s in range(0, len(letters), 4000):
            part = letters[s:s + 4000]
            new.update(zip(part, self._ask_model(
                [p.lower() for p in part] if self.folds else part)))
        for s in range(0, len(rest), 4000):
            new.update(zip(rest[s:s + 4000], self._ask(rest[s:s + 4000])))
        if self.size < KEPT_BYTES:
            room = 1 + (KEPT_BYTES - self.size) // (ENTRY + 4 * LONGEST)
            short = dict(islice(((p, ids) for p, ids in new.items() if len(p) <= LONGEST), room))
            self.known.update(short)
            self.size += ENTRY * len(short) + 2 * sum(map(len, short)) + sum(map(len, short.values()))
        return new

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._cut(t) for t in texts]
        ids = [list(map(self.known.get, c)) if c else [] for c in cut]
        holes = [[k for k, x in enumerate(i) if x is None] if None in i else () for i in ids]
        missing = {c[k] for c, h in zip(cut, holes) for k in h}
        new = self._learn(missing) if missing else {}
        for text, c, i, h in zip(texts, cut, ids, holes):
            if c is None:
                yield self._ask([text])[0]
                continue
            for k in h:
                i[k] = new[c[k]]
            yield b"".join(i)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text; null counts as empty."""
        part, size = [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= TOGETHER:
                yield from self._encode(part)
                part, size = [], 0
        yield from self._encode(part)


def encoder(path: str) -> Encoder:
    """The encoder that this worker keeps for a tokenizer file."""
    return kept(("encoder", path), lambda: Encoder(path))


def vocabulary_width(path: str) -> int:
    """Bytes that an id of the tokenizer needs."""
    return Encoder(path).width


def widened(ids: bytes, width: int) -> bytes:
    """Ids of ``width`` bytes as unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
