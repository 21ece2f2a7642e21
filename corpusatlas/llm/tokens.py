"""Texts to ids with the tokenizers library, with a bounded cache of words in front of it.

Where the tokenizer drops white space (its first split keeps only pieces without any), a text's ids are the ids of its
space-separated chunks one after the other. Each worker keeps the chunks it has met; only new ones reach the library.
Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import re

from corpusatlas.llm.common import cache

#: Chunks for which lower-casing and splitting need no more than this: Latin letters, then closing punctuation.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_CODERS: dict = cache({})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_chunks: int = 250_000, max_pieces: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.model = (t := Tokenizer.from_file(path)), t.model
        self.vocabulary = t.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = splits[0] if splits else {}
        self.by_chunk = (
            [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and (first["behavior"], first["invert"]) == ("Removed", True)
            and first["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not spec.get("post_processor")
        )
        self.alphabet, self.max_chunks, self.max_pieces = byte_alphabet(), max_chunks, max_pieces
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a lower-cased run of letters, or of punctuation."""
        if (got := self.pieces.get(piece)) is None:
            if len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            spelt = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            got = self.pieces[piece] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._library(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.chunks) >= self.max_chunks:
            self.chunks = {"": b""}
        chunks, odd = self.chunks, []
        for word in set().union(*split):
            if word not in chunks:
                if m := PLAIN.fullmatch(word):
                    letters, end = m.groups()
                    chunks[word] = self._piece(letters.lower()) + (self._piece(end) if end else b"")
                else:
                    odd.append(word)
        if odd:
            chunks.update(zip(odd, self._library(odd), strict=True))
        return [b"".join(map(chunks.__getitem__, parts)) for parts in split]


def coder(path: str | None = None) -> Coder:
    """The worker's own coder of a tokenizer file, made once."""
    path = path or default_tokenizer()
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def coders() -> dict:
    """The worker's coders."""
    return _CODERS
