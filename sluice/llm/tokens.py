"""Token ids by the public tokenizers, word by word.

Both vocabularies cut a text into words before they merge, and no word crosses the points at which texts are cut here; so
the ids of a text are those of its pieces, one after the other. A task keeps the ids of the pieces that it has seen. Texts
that hold the string of an added token, which the vocabulary looks for before all else, are encoded whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from sluice.llm.common import KEPT

_TWO_SPACES = re.compile(r"\s\s")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
END_ID = 2


def _lowered(text: str) -> str:
    """In lower case, as the vocabulary does it later, where letters are ASCII or Latin-1 and so change one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: printable ones as themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)}


class Pieces(dict):
    """piece -> its ids. Full, it becomes the older half, from which pieces still in use come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of whole texts. kind: "word" (white space is dropped) or "byte" (it counts)."""

    def __init__(self, path: str, kind: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens must be sought in texts as they are")
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.model = self.tokenizer.model
        self.kind = kind
        self.letters = _byte_letters()
        self.space, self.feed = self.letters[32], self.letters[10]
        self.marks = Pieces(self._ids, 10_000)
        if kind == "word":
            self.first = self.rest = Pieces(self._word_piece, most)
        else:
            self.first, self.rest = Pieces(self._first_piece, most // 8), Pieces(self._byte_piece, most)

    def _ids(self, seen: str) -> bytes:
        """Ids of one word as the vocabulary cuts it, written in its letters."""
        ids = [t.id for t in self.model.tokenize(seen)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str, piece: bool = True) -> bytes:
        """Lower case can make the string of an added token in a piece of a text that doesn't hold it; there it is ordinary text."""
        self.tokenizer.encode_special_tokens = piece and self.added.search(text) is not None
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = False
        return np.array(ids, "<u4").tobytes()

    def _plain(self, s: str, lead: str) -> bytes | None:
        """Ids of Latin letters with ASCII marks behind, None for all else; lead: the space before, as the vocabulary writes it."""
        core = s.rstrip(_ASCII_MARKS)
        if not core.isalpha():
            return None
        marks = s[len(core) :]
        if not core.isascii():
            if max(core) >= "ɐ":
                return None
            core = core.encode("utf-8").decode("latin-1").translate(self.letters)
        return self._ids(lead + core) + self.marks[marks] if marks else self._ids(lead + core)

    def _word_piece(self, piece: bytes) -> bytes:
        s = piece.decode("utf-8", "surrogatepass")
        low = s.lower()
        ids = self._plain(low, "")
        return self._whole(s) if ids is None else ids

    def _first_piece(self, piece: str) -> bytes:
        ids = self._plain(piece, "")
        return self._whole(piece) if ids is None else ids

    def _byte_piece(self, piece: str) -> bytes:
        if piece[:1] == "\n":
            ids = self._plain(piece[1:], "")
            return self._whole(piece) if ids is None else self._ids(self.feed) + ids
        ids = self._plain(piece, self.space)
        return self._whole(" " + piece) if ids is None else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [bool(t) and self.added.search(t) is not None for t in texts]
        if any(found):
            rest = iter(self.encode([t for t, f in zip(texts, found) if not f]))
            return [self._whole(t, piece=False) if f else next(rest) for t, f in zip(texts, found)]
        get = self.rest.__getitem__
        if self.kind == "word":
            return [b"".join(map(get, _lowered(t or "").encode("utf-8", "surrogatepass").split())) for t in texts]
        out = []
        for t in texts:
            t = t or ""
            if t and not _TWO_SPACES.search(t) and not t[0].isspace() and not t[-1].isspace():
                p = t.replace("\n", " \n").split(" ")  # a lone line feed ends a word as a lone space does
            else:
                p = _INNER_SPACE.split(t)
            out.append(self.first[p[0]] + b"".join(map(get, p[1:])))
        return out


def encoder(path: str, kind: str, most: int = 400_000) -> PieceEncoder:
    """One for each Python worker, until a task of another kind lets it go; later tasks of the worker find its words. `most` pieces, and
    as many older ones, are kept."""
    key = ("encoder", path, kind)
    if key not in KEPT:
        KEPT[key] = PieceEncoder(path, kind, most)
    return KEPT[key]


def encode_slices(texts: list, enc: PieceEncoder, most_chars: int = 1_000_000):
    """(position, ids) of each text, over slices of bounded size, so that one batch never holds all its pieces."""
    start = 0
    while start < len(texts):
        size, stop = 0, start
        while stop < len(texts) and (stop == start or size < most_chars):
            size += len(texts[stop] or "")
            stop += 1
        yield from zip(range(start, stop), enc.encode(texts[start:stop]))
        start = stop
