"""Whole texts to token ids by the tokenizers library, with bounded caches of words."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowgraph.llm.textops import ranges

#: White space by Unicode, as the tokenizers see it.
_WHITE = "\t-\r \x85\xa0  -     　"
#: Pieces that no token of a byte-level tokenizer crosses: a word with the space before it, or white space.
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space to Python but not to the tokenizers.
_SEPARATOR = re.compile("[\x1c-\x1f]")
#: Texts of code points below this are cut into pre-tokens here; others by the tokenizer.
_LATIN = 0x250
_PIECES, _LONGEST = 800_000, 64
#: Marks cuts; a text that has it is encoded whole. Signs before which a word is cut.
_CUT, _STOPS = "\x1f", ".,;:!?"
#: A piece that is neither a line's end nor a word with at most a space before it.
_ODD_KEPT = r"^$|^ $|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|(?s:.)[ \n]|\n(?s:.)"


def _class(kinds: str) -> str:
    """The code points below _LATIN whose general category begins with one of these letters, for a regular expression."""
    return "".join(re.escape(chr(i)) for i in range(_LATIN) if unicodedata.category(chr(i))[0] in kinds)


@cache
def _pretoken_pattern(spaces: bool) -> re.Pattern:
    """The tokenizer file's own pattern, over Latin text without white space but for a space at the front."""
    letter, number = _class("L"), _class("N")
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    if spaces:
        return re.compile(f"{ends}| ?[{letter}]+| ?[{number}]+| ?[^{_WHITE}{letter}{number}]+")
    return re.compile(f"{ends}|[{letter}]+|[{number}]|[^{_WHITE}{letter}{number}]+")


@cache
def _byte_signs() -> str:
    """The characters that stand for the bytes in a byte-level vocabulary, in order: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


def strings(values: pa.Array) -> list[str]:
    """to_pylist() of strings at a fraction of its cost, as Arrow makes no scalar of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


class _Cache(dict):
    """Ids by string; what is missing is computed and, unless it is long, kept."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        ids = self.compute(word)
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts exactly as the tokenizer file does, each distinct pre-token of a batch once.

    No token crosses the border between a word and the white space after it, nor that between two pre-tokens, so a
    text's ids are its pre-tokens' ids one after another. Arrow cuts a batch before spaces, line ends and common
    punctuation and numbers the distinct pieces; only those are looked up, or encoded. Texts whose cuts are no borders
    (runs of punctuation or of white space) are cut by a pattern instead. spaces tells whether the tokenizer keeps
    white space, a single space with the word after it (and has no normalizer), or drops it (after NFC and
    lower-casing). special tells whether the file's added tokens are found in texts, as they are by default in the library;
    a text that holds one is encoded whole. Without it their strings are ordinary text. Ids come as bytes,
    little-endian unsigned 32-bit.
    """

    def __init__(self, path: str, spaces: bool, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model, self.spaces = self.tokenizer.model, spaces
        self.pieces = _Cache(self._piece)

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            signs = text
        elif text[0] == " " and text.isascii() and text[1:].isalpha():
            signs = "\u0120" + text[1:]
        else:
            signs = text.encode().decode("latin-1").translate(_byte_signs())
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _piece(self, text: str) -> bytes:
        """The ids of a piece that begins and ends at borders."""
        core = text[1:] if self.spaces and text[:1] == " " else text
        if core.isascii() and core.isalpha():
            return self._pretoken(text if self.spaces else text.lower())
        if self.spaces and len(text) <= _LONGEST and core.isalpha() and max(core) < chr(_LATIN):
            return self._pretoken(text)
        if not text or (not self.spaces and text.isspace() and not _SEPARATOR.search(text)):
            return b""
        if len(text) > _LONGEST or not (text.isascii() or (max(text) < chr(_LATIN) and unicodedata.is_normalized("NFC", text))):
            return self.direct(text)
        small = text if self.spaces else text.lower()
        parts = _pretoken_pattern(self.spaces).findall(small)
        if sum(map(len, parts)) != len(small) or not (small.isascii() or max(small) < chr(_LATIN)):
            return self.direct(text)
        return self._pretoken(small) if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def _text(self, text: str) -> bytes:
        if self.spaces:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        return self.direct(text) if _SEPARATOR.search(text) else b"".join(map(self.pieces.__getitem__, text.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.pieces) > _PIECES:
            self.pieces.clear()
        if not any(texts):
            return [b""] * len(texts)
        marked = pa.array(texts, pa.large_string())
        marks = [(" ", f"{_CUT} " if self.spaces else _CUT), ("\n", f"{_CUT}\n{_CUT}" if self.spaces else _CUT), *((c, _CUT + c) for c in _STOPS)]
        own = np.any([pc.match_substring(marked, sign).to_numpy(zero_copy_only=False) for sign in (_CUT, *self.added)], axis=0)
        for sign, cut in marks:
            marked = pc.replace_substring(marked, sign, cut)
        lists = pc.split_pattern(marked if self.spaces else pc.ascii_lower(marked), _CUT)
        coded = pc.dictionary_encode(lists.values)
        pieces, at, bounds = strings(coded.dictionary), coded.indices.to_numpy(), lists.offsets.to_numpy()
        ids = list(map(self.pieces.__getitem__, pieces))
        sizes = np.array([len(x) // 4 for x in ids])
        pool, starts = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
        flat = pool[ranges(starts[at], sizes[at])].tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(sizes[at])])[bounds].tolist()
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        stop, run, odd = (pc.match_substring_regex(coded.dictionary, r).to_numpy(zero_copy_only=False) for r in ("^[.,;:!?]", "[^\\pL\\pN]$|\u0130$", _ODD_KEPT if self.spaces else "[\\x1c-\\x1f]"))
        bad = odd[at]
        bad[:-1] |= run[at[:-1]] & stop[at[1:]]
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1).tolist() + np.flatnonzero(own).tolist():
            out[i] = self._text(texts[i]) if not own[i] else self.direct(texts[i])
        return out

    def forget(self) -> None:
        """Frees the known words: a worker that waits for other work holds none."""
        self.pieces.clear()


@cache
def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder for each tokenizer file and Python worker; its ids are the library's by default."""
    return Encoder(path, spaces, special=True)
