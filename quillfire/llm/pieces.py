"""Vocabulary files of public SentencePiece models, read without training."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
SPACE = "▁"


def _fields(buf: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, buf[i : i + size]
            i += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, buf[i : i + size]
            i += size
        else:
            raise ValueError(f"wire type {kind} is not used by SentencePiece models")


@dataclass(frozen=True)
class Pieces:
    """Ids, scores and bytes of a model's pieces."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    @property
    def normal(self) -> dict[str, int]:
        return {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}

    @property
    def bytes_ids(self) -> list[int]:
        ids = [i for i, k in enumerate(self.kinds) if k == BYTE]
        if len(ids) != 256:
            raise ValueError("the model has no byte fallback")
        return ids


def parse(model: bytes) -> Pieces:
    """Read a model file's content.

    Raises ValueError where the model needs what is not offered here: rules of
    normalisation, user-defined or unused pieces, or no byte fallback.
    """
    texts, scores, kinds = [], [], []
    prefix, rules = True, b""
    for number, value in _fields(model):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            texts.append(text), scores.append(score), kinds.append(kind)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    rules = v
                elif k == 3:
                    prefix = bool(v)
                elif k == 4 and v:
                    raise ValueError("removal of extra white space is not offered")
    if rules:
        raise ValueError("rules of normalisation are not offered")
    if USER in kinds or UNUSED in kinds:
        raise ValueError("user-defined and unused pieces are not offered")
    out = Pieces(texts, scores, kinds, prefix)
    if any(SPACE in t.lstrip(SPACE) for t in out.normal):
        raise ValueError("pieces that reach over white space are not offered")
    _ = out.bytes_ids
    return out


def read(path: str) -> bytes:
    """The model's bytes; ``path`` is a file or a folder holding the 32k model."""
    with open(os.path.join(path, "piece_bpe_32k.model") if os.path.isdir(path) else path, "rb") as f:
        return f.read()
