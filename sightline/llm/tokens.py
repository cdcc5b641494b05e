"""Token ids of whole texts with the tokenizers library.

Where a tokenizer drops white space, no token crosses it, so a text's ids are
the ids of its chunks between ASCII white space. Chunks repeat far more often
than texts, so each worker keeps the ids of chunks it has met, and of the
lower-cased letter runs inside them; both memories are bounded and only save
time. Other tokenizers encode each text as a whole.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import regex
from tokenizers import Tokenizer

#: Memory for chunks and for letter runs; when full they start anew.
CHUNKS, PIECES = 300_000, 500_000


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers put for each byte: itself if it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class _Memory(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """encode(text as UTF-8) gives ids as little-endian integers of `width`."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        pattern = self._pattern(spec)
        self.spaceless = pattern is not None
        if self.spaceless:
            self._split = regex.compile(pattern).findall
            self._letters = byte_letters()
            self._pieces = _Memory(self._piece, PIECES)
            self._chunks = _Memory(self._chunk, CHUNKS)

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The split pattern of a tokenizer that normalises by NFC, one space for white space and lower case, and keeps what the pattern finds; None for any other."""
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
            return None
        split, level = pre
        if not (split["invert"] and split["behavior"] == "Removed") or level["add_prefix_space"] or level["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            return None
        return split["pattern"].get("Regex")

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else "".join(map(self._letters.__getitem__, piece.encode()))
        return self._pack([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if max(text) >= "ɐ" or "İ" in text or "<|" in text:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text.isalpha():
            return self._pieces[text.lower()]
        if text[-1] in ".,!?|" and text[:-1].isalpha():
            return self._pieces[text[:-1].lower()] + self._pieces[text[-1]]
        return b"".join(map(self._pieces.__getitem__, self._split(text.lower())))

    def encode(self, text: bytes) -> bytes:
        if self.spaceless:
            return b"".join(map(self._chunks.__getitem__, text.split()))
        return self._pack(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
