"""SentencePiece encoding and decoding (merge type), exact, by backtracking.

A segmentation is the one that merging in order of score yields if and only if
every two adjacent tokens, merged again on their own, stay as they are.  So
instead of merging a whole text, tokens are laid left to right: an Aho-Corasick
automaton lists the pieces that begin at each position, the longest is tried
first, a token is laid only if it is compatible with the one before it, and
where none fits the last token is taken back and its end marked in a bitfield
of failed positions, which is never entered again.

Pieces never reach from a letter over a following space, so a text falls into
units (spaces, then other characters) that are encoded on their own; their
results are kept in a bounded cache.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillfire.llm import pieces as P
from quillfire.llm.common import TOKENIZERS, Generations, project, slices

UNIT = re.compile(f"{P.SPACE}*[^{P.SPACE}]+|{P.SPACE}+")
CACHED = 150_000


class MergeEncoder:
    """Exact merge-type encoder for one model; ``encode``/``decode`` on str."""

    def __init__(self, model: bytes):
        self.pieces = P.parse(model)
        self.ids = self.pieces.normal
        self.score = {t: self.pieces.scores[i] for t, i in self.ids.items()}
        self.bytes_ids = self.pieces.bytes_ids
        self.units = Generations(CACHED)
        self.pairs = Generations(CACHED)
        # pieces that merging can never yield are not laid
        self.automaton = ahocorasick.Automaton()
        inner = set()
        for t in self.ids:
            if len(t) > 1:
                inner.update(t)
                if self.merge(t) == [t]:
                    self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        # at these characters nothing merges, so they are units of their own
        self.barrier = re.compile("([\n\r\t])" if not inner & set("\n\r\t") else "(?!)(x)")
        self.raw: list[bytes] = []
        for i, (t, k) in enumerate(zip(self.pieces.texts, self.pieces.kinds)):
            if k == P.BYTE:
                self.raw.append(bytes([self.bytes_ids.index(i)]))
            else:
                self.raw.append(b"" if k == P.CONTROL else t.encode())

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first, the left one among equals."""
        score, parts = self.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay apart when they are merged again."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            known = a + b not in self.score and self.merge(a + b) == [a, b]
            self.pairs.put(key, known)
        return known

    def segment(self, unit: str) -> list[str]:
        """Tokens of one unit, by backtracking."""
        n = len(unit)
        if n == 1:
            return [unit]
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(unit):
            starts[end - len(piece) + 1].append(piece)
        failed = bytearray((n >> 3) + 1)
        tokens: list[str] = []
        trail: list[tuple[int, int]] = []
        pos = k = 0
        while pos < n:
            here = starts[pos]
            if not k:
                here.sort(key=len, reverse=True)
                if not here or len(here[-1]) > 1:
                    here.append(unit[pos])
            while k < len(here):
                token, k = here[k], k + 1
                end = pos + len(token)
                if failed[end >> 3] >> (end & 7) & 1 or tokens and not self.fits(tokens[-1], token):
                    continue
                trail.append((pos, k))
                tokens.append(token)
                pos, k = end, 0
                break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos, k = trail.pop()
                tokens.pop()
        return tokens

    def unit(self, unit: str) -> bytes:
        """Ids of one unit as little-endian int32."""
        if (known := self.units.get(unit)) is not None:
            return known
        out: list[int] = []
        for part in self.barrier.split(unit):
            if not part:
                continue
            for token in self.segment(part):
                if (i := self.ids.get(token)) is not None:
                    out.append(i)
                else:
                    out.extend(self.bytes_ids[b] for b in token.encode("utf-8"))
        packed = np.array(out, "<i4").tobytes()
        self.units.put(unit, packed)
        return packed

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        if " " in text:
            text = text.replace(" ", P.SPACE)
        if self.pieces.dummy_prefix:
            text = P.SPACE + text
        units = UNIT.findall(text)
        new = self.units.new
        found = [new.get(u) for u in units]
        if None in found:
            found = [self.unit(u) if f is None else f for u, f in zip(units, found)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(P.SPACE, " ")
        return text[1:] if self.pieces.dummy_prefix and text[:1] == " " else text


_ENCODERS: dict[bytes, MergeEncoder] = {}


def encoder(model: bytes) -> MergeEncoder:
    """One encoder a Python worker."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = MergeEncoder(model)
    return _ENCODERS[model]


def encode_documents(
    docs: DataFrame, tokenizer: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every text, and whether decoding them gives it back.

    Result: ``doc_id, ids, n_tokens, lossless``, one row for each input row,
    repeated rows included.  A null text has null in the other columns; an empty
    text has no ids and is lossless.  A text holding the marker U+2581 itself
    reads as if it held spaces, as the format has it, and isn't lossless.  Texts
    of any length are encoded whole.  Other columns are left out, whatever
    their names.  ``tokenizer`` is a model file, or a folder with the 32k model;
    it is read on the driver and its 0.5 MB travel with the tasks.

    Map-only: no shuffle, so cost grows with the text alone.
    """
    model = P.read(tokenizer)

    def run(batches):
        enc = encoder(model)
        for batch in slices(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            packed = [None if t is None else enc.packed(t) for t in texts]
            sizes = np.fromiter((len(p or b"") // 4 for p in packed), "i4", len(packed))
            flat = np.frombuffer(b"".join([p or b"" for p in packed]), "<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
            null = np.array([p is None for p in packed])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32(), mask=np.append(null, False)), pa.array(flat, pa.int32())
            )
            same = [
                None if t is None else enc.decode(flat[a:b].tolist()) == t
                for t, a, b in zip(texts, offsets[:-1], offsets[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(sizes, pa.int32(), mask=null), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_tokens", "lossless"],
            )

    src = project(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, lossless boolean")


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZERS) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give a null text."""
    model = P.read(tokenizer)

    def run(batches):
        enc = encoder(model)
        for batch in batches:
            texts = [None if ids is None else enc.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    src = project(encoded, doc_id="doc_id", ids="ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
