"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The model file's pieces and scores are read; nothing is trained.  A text gets
the model's dummy prefix, spaces become the mark, and it is cut into marked
words where no piece can cross (checked against the vocabulary).  A batch's
distinct words are sorted, which lays them out as a depth-first walk of their
trie: forward scores of the prefix that a word shares with the one before it
are kept, and only the rest is computed.  Each word gets the segmentation of
highest total score; characters in no piece are coded as byte pieces.

Decoding turns the marks of pieces back into spaces and joins them with the
bytes of byte pieces.  A mark (U+2581) that is in the text itself is coded by its
bytes, so it comes back as it was.

Defined results: null text stays null in ``ids``'s place (no ids) and decodes to
an empty text; empty texts have no ids; very long texts are coded whole; rows
are coded one by one, so ties, repeated rows, null ids and empty tables need no
care; other columns pass through and columns named like a result, in whatever
case, are replaced.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, ship, text_udf, trimmed, whole, with_fields

MARK = "▁"
#: Stands for a mark of the text itself among its words (no marked word looks like it).
OWN_MARK = "x" + MARK
#: An unknown character costs so much more than the worst piece (the library's value).
UNKNOWN_PENALTY = 10.0
#: Words kept between the batches of a task; the table is emptied when it is full.
MOST_WORDS = 400_000


class Vocabulary:
    """Pieces of a SentencePiece model file, read from its protocol-buffer fields."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
        # Kinds of the file format: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte.
        self.normal = {p: (s, i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (1, 4)}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.bytes_of = [bytes([self.byte_of[i]]) if k == 6 else p.replace(MARK, " ").encode() if k in (1, 4) else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.unknown = min(s for s, _ in self.normal.values()) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece goes over a word's end")
        # A line feed ends a word too if it is in no piece.
        self.words = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not any("\n" in p for p in self.normal) else rf"{MARK}*[^{MARK}]+|{MARK}+")


    @cached_property
    def endings(self) -> dict[str, float | None]:
        """All endings of pieces with a piece's score, or None for an ending that is no piece; decoding needs none."""
        out: dict[str, float | None] = {p[i:]: None for p in self.normal for i in range(1, len(p))}
        return out | {p: s for p, (s, _) in self.normal.items()}


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    def learn(self, words: list[str]) -> None:
        """Segment distinct words, in sorted order, reusing the scores of shared prefixes."""
        normal, endings, unknown, none = self.v.normal, self.v.endings, self.v.unknown, float("-inf")
        best: list[float] = [0.0]
        back: list[int] = [0]
        before = ""
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(size, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, size + 1):
                # Longer and longer candidates, until no piece ends like them; ties go to the longest.
                top, start, at = none, 0, end
                while at:
                    at -= 1
                    score = endings.get(word[at:end], none)
                    if score is None:
                        continue
                    if score == none:
                        break
                    score += best[at]
                    if score >= top:
                        top, start = score, at
                if top <= best[end - 1] + unknown:
                    top, start = best[end - 1] + unknown, end - 1
                best.append(top)
                back.append(start)
            ids: list[int] = []
            end = size
            while end:
                start = back[end]
                piece = normal.get(word[start:end])
                ids += [piece[1]] if piece is not None else [self.v.byte[b] for b in reversed(word[start:end].encode())]
                end = start
            self.known[word] = array("i", ids[::-1]).tobytes()
            before = word

    def cut(self, text: str) -> list[str]:
        """Marked words; a mark in the text itself is a word of its own and is coded by its bytes."""
        first, *rest = text.split(MARK)
        out = self.v.words.findall(MARK + first.replace(" ", MARK))
        for part in rest:
            out.append(OWN_MARK)
            out += self.v.words.findall(part.replace(" ", MARK))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row bounds of a batch."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known.clear()
            fresh = set().union(*cut)
        self.learn(list(fresh - {OWN_MARK}))
        self.known[OWN_MARK] = array("i", [self.v.byte[b] for b in MARK.encode()]).tobytes()
        rows = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *(len(r) // 4 for r in rows)])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model(model: str | bytes) -> bytes:
    return model if isinstance(model, bytes) else open(model, "rb").read()  # noqa: SIM115


def encode(docs: DataFrame, model: str | bytes, text: str = "text") -> DataFrame:
    """``docs`` with ids; ``model`` is a model file's content or a path the driver can read."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model))

    def make():
        encoder = Encoder(Vocabulary(shared.value))

        def work(_, texts: pa.Array) -> list:
            ids, bounds = encoder.encode(texts.to_pylist())
            return [lists(ids, bounds, pa.int32())]

        return work

    return with_fields(docs, text_udf(make, "ids array<int>")(text), ["ids"])


def encode_decode(docs: DataFrame, model: str | bytes, text: str = "text", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ids and the text that these decode to: ``decode(encode(docs))`` in one pass through a worker."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model))

    def make():
        encoder = Encoder(Vocabulary(shared.value))

        def work(_, texts: pa.Array) -> list:
            ids, bounds = encoder.encode(texts.to_pylist())
            return [lists(ids, bounds, pa.int32()), [encoder.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]]

        return work

    return with_fields(docs, text_udf(make, f"ids array<int>, {decoded} string")(text), ["ids", decoded])


def decode(coded: DataFrame, model: str | bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; a null list decodes to an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value))
        for column in batches:
            yield pa.array([encoder.decode(i.values.to_numpy()) if i.is_valid else "" for i in whole(column)], pa.string())

    ship(coded.sparkSession)
    return coded.withColumn(text, F.arrow_udf(trimmed(run), "string", F.ArrowUDFType.SCALAR_ITER)(ids))


