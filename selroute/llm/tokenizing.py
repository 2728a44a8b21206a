"""Public tokenizers inside tasks, and cut points at which a text can be split without changing its tokens.

For a byte-level BPE file the ``tokenizers`` library defines the ids. A piece whose characters all lie below U+0250 is encoded
by ``tiktoken`` with the same vocabulary as ranks: on these characters both libraries split alike (letters, digits and white
space are the same in every Unicode version) and merge alike. Any other piece goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
_UNCOMMON = re.compile("[^\x00-ɏ]")
# A white space character right after a visible ASCII character always starts a new pre-token, and no token reaches over it. The same
# holds for white space and full-width marks right after a letter of a script that writes long lines without blanks (kana, Han,
# Hangul): a run of letters ends there, and the special strings, which are ASCII, can't lie across.
_SAFE_CUT = re.compile("(?<=[!-~])[ \n\t]|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])[ \n\t\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")


class ByteBpe:
    """Ids of a byte-level BPE file as the ``tokenizers`` library gives them with its defaults."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for content, i in self.special.items():
            self.pieces[i] = content.encode()

    def encode(self, text: str) -> list[int]:
        if not text.isascii() and _UNCOMMON.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if self._split is None or not any(s in text for s in self.special):
            return self.ranks.encode_ordinary(text)
        ids: list[int] = []
        for part in self._split.split(text):
            ids.extend([self.special[part]] if part in self.special else self.ranks.encode_ordinary(part))
        return ids

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text, by one batch call for all common texts and one for all others."""
        out = [0] * len(texts)
        common, other = [], []
        for i, text in enumerate(texts):
            if not text.isascii() and _UNCOMMON.search(text):
                other.append(i)
            elif self._split is not None and any(s in text for s in self.special):
                out[i] = len(self.encode(text))
            else:
                common.append(i)
        for i, ids in zip(common, self.ranks.encode_ordinary_batch([texts[i] for i in common], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, found in zip(other, self.library.encode_batch([texts[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = len(found)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Pieces:
    """Ids of a sentencepiece model; its normaliser works on whole texts, so these are never split."""

    def __init__(self, name: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def decode(self, ids) -> bytes:
        return self.model.decode([int(i) for i in ids]).encode()


class Library:
    """Any other file of the ``tokenizers`` library; never split."""

    def __init__(self, name: str):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.library.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> bytes:
        return self.library.decode([int(i) for i in ids], skip_special_tokens=False).encode()


@lru_cache(maxsize=4)
def tokenizer(name: str) -> ByteBpe | Pieces | Library:
    """Loaded once per Python worker."""
    if name.endswith(".model"):
        return Pieces(name)
    return ByteBpe(name) if os.path.exists(public_tokenizers.path(BYTE_BPE)) and name == BYTE_BPE else Library(name)


_CUT_HERE = np.zeros(256, dtype=bool)
_CUT_HERE[[32, 10, 9]] = True
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True


def safe_cuts(data: bytes) -> np.ndarray:
    """Byte positions at which a byte-level text may be cut: before white space that follows a visible ASCII character."""
    b = np.frombuffer(data, np.uint8)
    return np.flatnonzero(_CUT_HERE[b[1:]] & _VISIBLE[b[:-1]]) + 1


def split_safely(text: str, size: int) -> list[str]:
    """Cut at the first safe position after every ``size`` characters."""
    parts, start = [], 0
    while len(text) - start > size:
        m = _SAFE_CUT.search(text, start + size)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts
