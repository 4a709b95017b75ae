"""Whole texts to token ids, by the tokenizers library.

Texts of a large corpus repeat their words. A text is cut at places where the tokenizer's own
pre-tokenisation always cuts, each distinct chunk is encoded once by the library's model, and
the ids of a text are the joined ids of its chunks. ``Encoder.direct`` is the plain call that
this must equal; tests hold the two against each other. A vocabulary file whose steps before
the model aren't those that the cuts are made for, and a text that holds one of the file's
added tokens, go through the plain call.
"""

from __future__ import annotations

import json
import sys

import regex
from tokenizers import Tokenizer

#: Bytes of memory that an encoder's cache may take; beyond that it begins anew.
CACHE_BYTES = 96_000_000
#: Characters of the longest chunk that is kept.
CHUNK_CHARS = 48
#: Bits of the hash by which a chunk that was met before is known; a byte for each value.
MET_BITS = 22

#: The pre-tokenisation patterns that the two vocabularies were built with.
BYTE_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Below this code point every Unicode version agrees on classes, and NFC changes nothing.
PLAIN_BELOW = "ɐ"
#: Marks that make one piece with their like after a letter; the apostrophe, which may begin a piece of its own, isn't one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: What the two kinds do to a text before the model, in the vocabulary file's terms.
STEPS = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}},
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    },
}


def _plain(steps):
    """Steps without what concerns offsets alone."""
    if isinstance(steps, dict):
        return {k: _plain(v) for k, v in steps.items() if k != "trim_offsets"}
    return [_plain(s) for s in steps] if isinstance(steps, list) else steps


def kind_of(described: dict) -> str | None:
    """Which kind of cuts fits a vocabulary file; None where no cut is known to be safe."""
    model = described["model"]
    if model["type"] != "BPE" or model.get("dropout") or described.get("post_processor") and described["post_processor"]["type"] != "ByteLevel":
        return None
    return next((k for k, steps in STEPS.items() if all(_plain(described.get(part)) == steps[part] for part in steps)), None)


def _byte_alphabet() -> str:
    """The printable stand-in of each byte in byte-level vocabularies, by that scheme's rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return "".join(out)


class _Chunks(dict):
    """Chunks and their ids; a chunk that isn't there yet is encoded when it is asked for, and kept
    if it is short, there is room, and it was met before: most distinct chunks of a large corpus
    occur once. Whether it was met is told by a table of hashes, where a clash costs room alone."""

    def __init__(self, encode, room: int):
        self.encode, self.room, self.held = encode, room, 0
        self.met = bytearray(1 << MET_BITS)

    def __missing__(self, chunk: str) -> bytes:
        got = self.encode(chunk)
        if len(chunk) <= CHUNK_CHARS and self.held < self.room:
            at = hash(chunk) & (1 << MET_BITS) - 1
            if self.met[at]:
                self[chunk] = got
                self.held += sys.getsizeof(chunk) + sys.getsizeof(got) + 100  # and its place in the table
            else:
                self.met[at] = 1
        return got


class Encoder:
    """Texts to little-endian ids of ``width`` bytes, by one vocabulary file.

    Equal, id for id, to the library's plain call with add_special_tokens=False, which takes
    strings of added tokens in a text for those tokens. ``kind`` is that of the file: "byte"
    (byte-level pieces with their leading space), "word" (lower-cased pieces without white
    space) or None (any other: each text goes through the plain call). By default ids take 2
    bytes where the vocabulary allows, else 4.
    """

    def __init__(self, path: str, width: int | None = None, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        size = max(self.tokenizer.get_vocab_size(), 1 + max(self.tokenizer.get_vocab().values(), default=0))
        self.kind, self.width = kind_of(described), width or (2 if size <= 1 << 16 else 4)
        added = described.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            self.kind = None
        self.added = [t["content"] for t in added]
        self.model = self.tokenizer.model
        if self.kind:
            self.model._resize_cache(0)  # the chunks that the model gets are those that no cache knows
        self.find = regex.compile(BYTE_PIECES if self.kind == "byte" else WORD_PIECES).findall
        self.alphabet = {b: c for b, c in enumerate(_byte_alphabet())}
        self.cache = _Chunks(self._encode_chunk, cache_bytes)
        self.pieces: dict[str, bytes] = {}
        self.packed = [i.to_bytes(self.width, "little") for i in range(size)]

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in ids])

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece of the pre-tokenisation."""
        shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.model.tokenize(shown)])

    def _word(self, piece: str) -> bytes:
        """The ids of a word beside punctuation, which may be a chunk of its own."""
        return self.cache.get(piece) or self._piece(piece)

    def _short(self, piece: str) -> bytes:
        """The ids of a piece, which is kept if it is short."""
        if len(piece) >= 4:
            return self._piece(piece)
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = self._piece(piece)
        return got

    def _encode_chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) >= PLAIN_BELOW:
            return self._pack(self.direct(chunk))
        # Letters alone, after a space if there is one, are one piece.
        if self.kind == "word":
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._piece(chunk)
        elif chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._piece(chunk)
        elif len(chunk) <= CHUNK_CHARS:
            # A word and marks, and words beside a full stop and a line feed, are cut without the pattern.
            word, stop, rest = chunk.partition(".\n")
            if stop and rest[:1].isalpha() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
                return self._word(word) + self._short(".") + self._short("\n") + (self._word(rest) if rest.isalpha() else self._encode_chunk(rest))
            word = chunk.rstrip(MARKS)
            if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) and len(word) < len(chunk):
                return self._word(word) + self._short(chunk[len(word) :])
        out = []
        for piece in self.find(chunk):
            if len(piece) >= 4 and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                out.append(self._word(piece))
            else:
                out.append(self._short(piece))
        return b"".join(out)

    def _chunks(self, text: str) -> list[str]:
        """Cut before each space that a visible character follows (byte), or at spaces (word)."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        parts = text.split(" ")
        out, at = [parts[0]], 0
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def encode(self, text: str) -> bytes:
        cache = self.cache
        if self.kind is None or any(t in text for t in self.added):
            return self._pack(self.direct(text))
        if self.kind == "byte" and ("  " in text or " \n" in text or "\t" in text or "\r" in text or " " == text[-1:]):
            chunks = self._chunks(text)
        elif self.kind == "byte":
            chunks = text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else self._chunks(text)
        else:
            chunks = self._chunks(text)
        if cache.held >= cache.room:
            cache.clear()
            cache.held = 0
            self.pieces.clear()
        return b"".join(map(cache.__getitem__, chunks))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, width: int | None = None) -> Encoder:
    """The encoder of this worker process for a vocabulary file, kept between tasks."""
    key = (path, width)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, width)
    return _ENCODERS[key]
