"""Token ids of whole texts, encoding each different space-separated piece once."""

from __future__ import annotations

import json
import os
from unicodedata import normalize, ucd_3_2_0

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pieces of one generation that a worker remembers; what is not asked for during the next one is forgotten.
REMEMBERED = 250_000
#: Longer pieces are encoded each time.
LONG = 80
#: ASCII marks; a run of them that ends a piece is one unit to the tokenizer, apart from the letters before it.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the Latin-1 letters: printable bytes stand for themselves, the others for 256 upwards in turn."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    spelling = {b: chr(b if b in printable else next(rest)) for b in range(256)}
    return {c: "".join(spelling[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def lettered(word: str) -> bool:
    """Whether a word is letters to every tokenizer and stays so when composed and in lower case.

    A capital I with a dot, and some composed letters, become a letter and a mark. The letters of Unicode 3.2 are letters in all
    later versions.
    """
    if word.isascii():
        return word.isalpha()
    return all(ucd_3_2_0.category(c)[0] == "L" for c in word) and normalize("NFC", word).lower().isalpha()


class _Known(dict):
    """Ids of pieces, made when first asked for."""

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        self.encoder, self.older = encoder, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class Encoder:
    """Little-endian unsigned 32-bit ids of texts.

    A tokenizer whose steps are known to drop white space, never to join across it, and to treat letters and marks apart
    gives a text the ids of the pieces between its spaces and line feeds, one after another; a plain word's ids then come
    from the model directly, and every other piece goes through the whole tokenizer. All other tokenizers get whole texts.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = specials_as_text
        self.model, self.letters = self.inner.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        folds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        self.direct = steps == ["Split", "ByteLevel"] and folds == ["NFC", "Replace", "Lowercase"] and bool(made["model"].get("end_of_word_suffix"))
        # special tokens are sought in the text as it is, so none of them may depend on upper case
        self.folds = self.direct and all(t["content"] == t["content"].lower() for t in made["added_tokens"])
        self.specials = () if specials_as_text else tuple(t["content"] for t in made["added_tokens"])
        self.bare = frozenset(map(chr, self.letters)) - {"\xd7", "\xf7"}
        self.known = _Known(self, {})

    def _whole(self, piece: str) -> bytes:
        return np.array(self.inner.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece: its letters, which may be upper case, and then its marks, if it is just these."""
        if self.direct and len(piece) <= LONG:
            if piece.isalpha() and (piece.isascii() or all(c <= "z" or c in self.bare for c in piece)):
                word = piece.lower()
                if word != piece:
                    return self.known[word]
                return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
            word = piece
            while word and word[-1] in _MARKS:
                word = word[:-1]
            if word and len(word) < len(piece) and lettered(word):
                return self.known[word] + self.known[piece[len(word) :]]
        return self._whole(piece)

    def _split(self, text: str | None) -> list[str]:
        if not self.direct:
            return [text or ""]
        text = (text or "").replace("\n", " ")
        if self.folds:
            try:  # beyond Latin-1, lower case can depend on a letter's neighbours
                text.encode("latin-1")
                lower = text.lower()
                if not any(s in lower for s in self.specials):
                    text = lower
            except UnicodeEncodeError:
                pass
        return text.split(" ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.older = {}
            self.known = _Known(self, self.known)
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._split(t))) for t in texts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a file, which keeps what it remembers from task to task."""
    if (path, specials_as_text) not in _encoders:
        _encoders[path, specials_as_text] = Encoder(path, specials_as_text)
    return _encoders[path, specials_as_text]


def public_path(name: str) -> str:
    """Where a file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
