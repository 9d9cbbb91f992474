"""Exact token ids for whole texts, through the `tokenizers` library, with a bounded memo of word pieces.

The byte-level vocabulary never merges across the start of a white-space run, so a text may be cut in front of
each such run and the pieces encoded apart. Pieces repeat, and a dictionary look-up costs far less than a second
encoding. Texts that hold a character whose white-space class differs between libraries, or a special token's
opening, are encoded whole. The memo only saves work: when it is full, only the last text's pieces stay.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np

#: A space and a Latin word that no other letter follows; one line end before such a word; else up to the next white space.
_FIND = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])|\n(?=[A-Za-z])|\s*\S+|\s+").findall
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Characters on which Python's and the tokenizer's idea of white space may differ.
_ODD = re.compile("[\x1c-\x1f\x85᠎​-‍  ⁠﻿]").search


def _byte_level() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LEVEL = _byte_level()
_LOADED: dict[str, "PieceCoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, the library that reads it and the options used."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library

    with open(path, "rb") as f:
        return hashlib.md5(f.read() + f"|{library.__name__} {library.__version__}|no specials added".encode()).hexdigest()


class _Memo(dict):
    """Piece to id bytes; an unknown piece is encoded when it is first asked for."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok
        self.tokenize = tok.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if _WORD(piece):  # one pre-token, so it goes straight to the vocabulary's merge model
            ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(_BYTE_LEVEL))]
        else:
            ids = self.tok.encode(piece, add_special_tokens=False).ids
        self[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class PieceCoder:
    """Encodes texts to ids (little-endian unsigned 32-bit bytes)."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.memo = _Memo(self.tok)
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))).search if specials else (lambda _: None)
        # Cutting is sound for a byte-level pre-tokenizer without a normalizer; any other vocabulary is encoded whole.
        self.cut = self.tok.normalizer is None and type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and not self.tok.pre_tokenizer.add_prefix_space

    def encode(self, text: str) -> bytes:
        if not self.cut or _ODD(text) or self.special(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = _FIND(text)
        if len(self.memo) > self.limit:
            kept = {p: self.memo[p] for p in set(pieces) if p in self.memo}
            self.memo.clear()
            self.memo.update(kept)
        return b"".join(map(self.memo.__getitem__, pieces))


def coder(path: str) -> PieceCoder:
    """One coder for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = PieceCoder(path)
    return _LOADED[path]
