"""Token ids by the tokenizers library, with the ids of repeated pieces of text kept in memory.

Byte-pair encoding works within the pieces that the pre-tokenizer cuts, so the ids of a text are those of its pieces
in a row. Texts are cut only where the pre-tokenizer is sure to cut as well, and each distinct piece goes through the
library once for as long as it is remembered. A text that may hold an added token (its first two characters, such as
`<|`, occur) goes to the library whole, on the library's default settings: the token's own id comes out where the
text spells it. Tests compare the result with the library's for whole texts.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import unicodedata
from collections.abc import Callable
from contextlib import suppress
from string import punctuation

import numpy as np
from tokenizers import Tokenizer

#: A worker is one task's; the library's own threads would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by one Python worker in two generations of half as many each; a full one takes the place of the
#: older one, whose pieces are taken over when met again. About 170 bytes each. A piece is remembered when its slot among
#: SLOTS has been met before, so that most of those that occur once take no room.
REMEMBERED, SLOTS = 800_000, 1 << 22

#: White space other than blank and line feed, and code points that regular-expression libraries class differently.
_ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, [*range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF]))
_DOUBTFUL = "\x1c\x1d\x1e\x1f\u180e" + "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF]))
#: White-space runs as the byte-level pre-tokenizer leaves them: all but the last before a word, then the rest.
_RUNS = re.compile(r"\s+(?!\S)| ?\S+|\s")
_MARK = "\x00"


def _has(text: str, characters: str) -> bool:
    """Whether any of the characters is in the text: a search for each is quicker than one for their class."""
    return any(c in text for c in characters)


def _byte_signs() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = "".join(_byte_signs()[b] for b in range(256))


def _signs(word: str) -> str:
    """The signs of a word's bytes. The signs of ASCII letters are those letters."""
    return word.replace(" ", BYTE_SIGNS[0x20]) if word.isascii() else codecs.charmap_decode(word.encode(), "strict", BYTE_SIGNS)[0]


def _by_space(text: str) -> list[str] | None:
    """Pieces under a byte-level pre-tokenizer whose words take one leading blank. None: not sure, encode the whole text."""
    if _MARK in text:
        return None
    if "  " in text or " \n" in text or "\n\n" in text or "\n " in text or _has(text, _ODD_SPACE):
        return None if _has(text, _DOUBTFUL) else _RUNS.findall(text)
    return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n" + _MARK).split(_MARK)


def _by_words(text: str) -> list[str] | None:
    """Pieces under a pre-tokenizer that drops white space."""
    return None if _has(text, _DOUBTFUL) else text.split()


def _plain_word(piece: str) -> str | None:
    """A word as the vocabulary's normalizer leaves it: composed, then lower-cased by single characters. None: not a plain word."""
    word = piece.lower() if piece.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
    return word if word.isalpha() else None


#: How each public vocabulary's pre-tokenizer lets texts be cut.
WORDS: dict[str, Callable[[str], str | None]] = {"space": lambda p: p if p.lstrip(" ").isalpha() else None, "words": _plain_word, "whole": lambda p: None}
CUTS: dict[str, Callable[[str], list[str] | None]] = {"space": _by_space, "words": _by_words, "whole": lambda text: None}


class PieceEncoder:
    """encode(texts): an array of ids for each. `cut` names an entry of CUTS that suits the vocabulary."""

    def __init__(self, path: str, cut: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self._word = CUTS[cut], WORDS[cut]
        added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self._added = {v for a in added for v in (a, a.lower(), a.upper(), a.title(), a.swapcase())}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met = bytearray(SLOTS)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _ids(self, piece: str) -> bytes:
        """Both pre-tokenizers part letters from the ASCII punctuation that closes a piece, so a word need not be learned with each."""
        known, old, met = self.known, self.old, self.met
        ids = old.get(piece)
        if ids is not None:
            known[piece] = ids
            return ids
        core = piece.rstrip(punctuation)
        # as normalised: what lower-casing leaves of a letter may be a mark, which joins the punctuation
        word = self._word(core) if core else None
        if word is not None:
            ids = known.get(word) or old.get(word)
            if ids is None:
                ids = self._pack([t.id for t in self.tokenizer.model.tokenize(_signs(word))])
                slot = hash(word) % SLOTS
                if met[slot]:
                    known[word] = ids
                met[slot] = 1
                if word == piece:
                    return ids
            if len(core) < len(piece):
                closing = piece[len(core) :]
                ids += known.get(closing) or self._ids(closing)
        elif piece:
            ids = self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        else:
            return b""
        slot = hash(piece) % SLOTS
        if met[slot]:
            known[piece] = ids
        met[slot] = 1
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            pieces = None if text and any(a in text for a in self._added) else self.cut(text or "")
            if pieces is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, self.dtype))
                continue
            if len(self.known) > REMEMBERED // 2:
                self.old, self.known, self.met = self.known, {}, bytearray(SLOTS)
            ids = list(map(self.known.get, pieces))
            with suppress(ValueError):  # none is left
                at = -1
                while True:
                    at = ids.index(None, at + 1)
                    ids[at] = self._ids(pieces[at])
            out.append(np.frombuffer(b"".join(ids), self.dtype))
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, cut: str) -> PieceEncoder:
    """This worker's encoder; workers are reused, and so is what it remembers."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = PieceEncoder(path, cut)
    return _ENCODERS[path, cut]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine. Each worker asks on its own, as paths may differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
