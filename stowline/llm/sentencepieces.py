"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces, one pass per unit of text.

The automaton reads a unit once; at each position its output links give every piece that ends there. For unigram
models a piece relaxes the best score at its end (Viterbi). For BPE models best scores cannot give the library's
result, which is the outcome of merges; there a piece is taken if it and the last piece before it are what the
merges make of those two alone, which holds for exactly one piece at each position of a text's encoding. Either
way the ids equal the library's.

Texts are cut into units where no piece can cross, so a unit's ids depend on nothing else and are cached per
worker, in bounded memory. Characters that no piece covers become byte pieces, or the unknown piece.

Defined cases: null and empty texts have no ids and decode to the empty text; decoding gives the normalised
text, in which U+2581 has become a blank; repeated rows each get a row; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
import struct
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_CODERS: dict = {}


class PieceCoder:
    def __init__(self, model_file: str, unigram: bool | None = None, limit: int = 150_000):
        """unigram: by default as the model says (True reads a BPE model's scores as a unigram model's)."""
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kind = proto.ModelProto.SentencePiece
        self.unigram = model.trainer_spec.model_type == 1 if unigram is None else unigram
        if not self.unigram and model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models")
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.raw = [self._raw(p, kind) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.limit, self.young, self.old, self.pairs = limit, {}, {}, {}

    def _raw(self, p, kind) -> bytes:
        if p.type == kind.BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        if p.type == kind.CONTROL:
            return b""
        return " ⁇ ".encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode()

    @cached_property
    def units(self) -> re.Pattern:
        """Cuts a text where no piece can cross: before a space mark, around characters that stand alone, and
        between a letter and a mark that follows a letter in no piece."""
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE and a != SPACE for a, b in inside):
            return re.compile(r"(?s).+")
        joined = {c for pair in inside for c in pair}
        alone = [c for c in map(chr, range(32)) if c not in joined]
        after_letter = {b for a, b in inside if a.isalpha()}
        marks = [c for c in ".,;:!?\"()[]{}$%&*#/<>|@" if c not in after_letter]
        own, stop = re.escape("".join(alone)), re.escape("".join(alone + marks))
        if not alone:
            return re.compile(rf"{SPACE}*+[^{SPACE}]++|{SPACE}+")
        # the letters up to a mark; else all up to the next space mark; else space marks; else a lone character
        return re.compile(rf"{SPACE}*+[^\W\d_]++(?=[{SPACE}{stop}]|\Z)|{SPACE}*+[^{SPACE}{own}]++|{SPACE}+|[{own}]")

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a text: the adjacent pair with the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: int, piece: int) -> bool:
        """Whether the merges leave `before` and `piece` as they are side by side (before -1: piece alone)."""
        key = (before, piece)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            own = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
            known = self.pairs[key] = self._merged("".join(own)) == own
        return known

    def _unit(self, unit: str) -> list[int]:
        """One pass: for every position the last piece of the text up to there and where that piece starts."""
        n = len(unit)
        start, last = [-1] * (n + 1), [-1] * (n + 1)
        best = [0.0] * (n + 1) if self.unigram else None
        done = 0  # positions up to here are settled
        for end, (piece, length) in self.automaton.iter(unit):
            end += 1
            while done < end - 1:
                done += 1
                self._settle(done, start, last, best)
            at = end - length
            if best is not None:
                score = best[at] + self.scores[piece]
                if start[end] < 0 or score > best[end]:
                    best[end], start[end], last[end] = score, at, piece
            elif start[end] < 0 and (at == 0 or last[at] >= 0 or last[at] == -2) and self._fits(max(last[at], -1), piece):
                start[end], last[end] = at, piece
        while done < n:
            done += 1
            self._settle(done, start, last, best)
        out: list[int] = []
        while n:
            if last[n] == -2:
                raw = unit[start[n] : n].encode("utf-8", "surrogatepass")
                own = [self.byte_ids.get(b, self.unknown) for b in raw] if self.byte_ids else [self.unknown]
                out += reversed(own)
            else:
                out.append(last[n])
            n = start[n]
        out.reverse()
        return out

    def _settle(self, end: int, start: list[int], last: list[int], best: list[float] | None) -> None:
        """At a position that no piece reaches: the character before it is unknown."""
        if best is not None:
            single = best[end - 1] + self.least
            if start[end] < 0:
                start[end], last[end], best[end] = end - 1, -2, single
        elif start[end] < 0:
            start[end], last[end] = end - 1, -2

    def _value(self, unit: str) -> bytes:
        value = self.old.get(unit)
        if value is None:
            ids = self._unit(unit)
            value = struct.pack(f"<{len(ids)}i", *ids)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[unit] = value
        return value

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)
        get, value = self.young.get, self._value
        out = b"".join([get(u) or value(u) for u in self.units.findall(text)])
        if self.byte_ids:
            return out
        ids = np.frombuffer(out, dtype="<i4")  # a run of unknown characters is one unknown piece
        return ids[~((ids == self.unknown) & np.r_[False, ids[:-1] == self.unknown])].tobytes() if len(ids) else out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _coder(model_file: str) -> PieceCoder:
    if model_file not in _CODERS:
        _CODERS[model_file] = PieceCoder(model_file)
    return _CODERS[model_file]


def encode(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Per row: doc_id, n_pieces, ids and (decoded) the text that the ids decode to."""

    def run(batches):
        import pyarrow as pa

        coder = _coder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                ids = np.frombuffer(b"".join(raw), dtype="<i4")
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                out = [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if decoded:
                    out.append(pa.array([coder.decode(ids[e - n : e].tolist()) for n, e in zip(sizes, ends, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_pieces", "ids", "decoded"][: len(out)])

    schema = "doc_id long, n_pieces long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with one more column, the text of the ids; null for null ids."""

    def text_of(columns):
        import pandas as pd

        coder = _coder(model_file)
        for column in columns:
            yield pd.Series([None if x is None else coder.decode(list(x)) for x in column])

    return encoded.withColumn(to, F.pandas_udf(text_of, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids)))
