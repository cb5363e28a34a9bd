"""Tokenizing whole texts inside Arrow tasks, with the ids of repeated words remembered.

In the two public BPE files' splitting patterns white space stands only at the start of a match,
and no match holds a letter followed by an ASCII punctuation mark. So a text may be cut before any
blank or line break that follows other text, and between a letter and a mark after it: the ids of
the pieces, joined, are the ids of the text. Each piece is encoded by the tokenizers library once
and then looked up. Texts with other white space (tabs, no-break blanks, ...) are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Pieces remembered by one Python worker; at about 250 bytes each this bounds the memory.
REMEMBERED = 1_000_000
#: Longer pieces are encoded but not remembered.
LONGEST = 40

_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PIECE = re.compile(
    rf"[ \n]*+[{_LETTER}]++(?=[ \n{_MARK}]|\Z)|[ \n]*+[{_MARK}]++(?=[ \n]|\Z)|[ \n]*+[^ \n]++|[ \n]++"
)
_OTHER_SPACE = re.compile(r"[^\S \n]")


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._known: dict[str, bytes] = {}
        self._remembered = remembered
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; None counts as an empty text."""
        known, whole = self._known, {}
        cut: list[list[str]] = []
        for at, text in enumerate(texts):
            if text and (_OTHER_SPACE.search(text) or any(s in text for s in self._specials)):
                whole[at] = self._encode([text])[0]
            cut.append(_PIECE.findall(text) if text and at not in whole else [])
        new = list(set().union(*cut).difference(known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self._encode(part), strict=True))
        out = [whole[at] if at in whole else b"".join(map(known.__getitem__, pieces)) for at, pieces in enumerate(cut)]
        for piece in new if len(known) > self._remembered else [p for p in new if len(p) > LONGEST]:
            del known[piece]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
