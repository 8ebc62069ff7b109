"""Exact tokenization by the public libraries, with one library call for each distinct word.

Both tokenizers here never let a token cross certain boundaries, so a text's ids are those of its
words put together, and a worker need only ask the library for words that it has not met. The memo
is bounded: what has not been used lately goes, which costs time and changes no result.
"""

from __future__ import annotations

import functools
import json
import re
import struct

SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


class Memo(dict):
    """key -> make(key), remembering between `room` and twice `room` of them."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room, self.older = make, room, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        self[key] = made
        return made


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Little-endian unsigned 32-bit ids of a text, by a `tokenizers` file whose pre-tokenizer drops white space.

    White space separates words for such a file, its normaliser (NFC, lower case for each character)
    looks across no ASCII space, and added tokens hold no space: so words are encoded apart. A word of
    Latin letters, digits and signs below U+0250 is also cut as the file's own pattern cuts it, and its
    lower-case pieces go to the file's BPE model alone, for the memo of pieces finds more; any other
    word goes through the whole library. A file of another make is not cut at all.
    """

    #: Of the characters below U+0250, in lower case, what the file's pattern cuts: the same by any edition of Unicode.
    LETTER, DIGIT = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
    PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]+").fullmatch
    CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{LETTER}{DIGIT}]+").findall
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MAKE = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel")

    def __init__(self, path: str, pieces: int = 400_000, words: int = 400_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        spec = json.loads(self.lib.to_str())
        steps = [*(spec["normalizer"] or {}).get("normalizers", []), *(spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.apart = tuple(x["type"] for x in steps) == self.MAKE and steps[3]["behavior"] == "Removed" and steps[3]["pattern"]["Regex"] == self.PATTERN
        self.apart = self.apart and all(re.fullmatch(r"<\S+", x["content"]) for x in spec["added_tokens"])
        self.letters = byte_letters()
        self.pieces, self.words = Memo(self._piece, pieces), Memo(self._word, words)

    def _library(self, text: str) -> bytes:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not word:
            return b""
        if "<" in text or not self.PLAIN(text):
            return self._library(text)
        return b"".join(map(self.pieces.__getitem__, self.CUT(text.lower())))

    def ids(self, text: bytes) -> bytes:
        if not self.apart:
            return self._library(text.decode())
        return b"".join(map(self.words.__getitem__, text.translate(SPACES).split(b" ")))


class PieceCounts:
    """Number of ids of a text, by a `sentencepiece` BPE model.

    A model qualifies when no piece holds the space mark or a line feed behind another character, and
    its normaliser changes nothing but spaces: then no merge crosses a space or a line feed, so the
    count is the sum over words. Texts with runs of spaces, and models that do not qualify, go to the
    library whole.
    """

    MARK = "▁"

    def __init__(self, path: str, words: int = 300_000):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        probe = "a  b\n\tc ½Åﬁ"
        self.apart = not any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in pieces) and self.lib.normalize(probe) == self.MARK + probe.replace(" ", self.MARK)
        self.words = Memo(self._word, words)

    def _word(self, word: bytes) -> int:
        """An element between spaces has the mark before it; one that a line feed begins has not, and gains one here."""
        return len(self.lib.encode(word.decode())) - (word[:1] == b"\n") if word else 1

    def count(self, text: bytes) -> int:
        if not text:
            return 0
        if not self.apart or b"  " in text or text[:1] == b" ":
            return len(self.lib.encode(text.decode()))
        return sum(map(self.words.__getitem__, text.replace(b"\n", b" \n").split(b" ")))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, whose memo serves all its tasks."""
    return WordIds(path)


@functools.cache
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
