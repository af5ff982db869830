"""Vector best-fit packing of token sequences.

A document's ids end with an id of their own; documents longer than a sequence
are cut into full pieces, of which the first may be shorter.  A piece asks three
things of a sequence: tokens, one document, and attention cost (its length
squared, as documents attend to themselves only).  Pieces are taken from long to
short.  Each goes to the open sequence that holds it under every capacity and
fits it best by its residual vector; only if none does, a new one is opened:

* ``rule="norm"``: the weighted norm of what would remain is least;
* ``rule="dot"``: the weighted dot product of residual and demand is least, so
  the sequence is tight where the piece is heavy.

Pieces of one length ask for the same, so the best fit is decided on the counts
by length, a table of a fixed size over all pieces: sequences with the same
residual are one class, and equal decisions are taken together.  That gives the
sequences that placing the pieces one by one would give.  A piece's number in the
order by length then says its place; the pieces are numbered by a range sort, so
no length, however common, meets in one task.

Ids come from a byte-level BPE tokenizer file.  The text is cut before spaces
where no token can cross; a task keeps the ids of the pieces that it has seen in
a table of a fixed size and encodes the others together.

Defined results: null text counts as empty; an empty text is its end id alone;
texts of any length are read whole; repeated rows are documents of their own; of
equal pieces any comes first; rows with a null key are packed; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAMMA, Block, Scratch, kind_of, lists, map_arrow, map_blocks, mix64, quoted, ranked, spans_hash

# -- ids --------------------------------------------------------------------------------

#: Slots of the table of known text pieces, and ids that it may hold before it is emptied.
SLOTS, MOST_IDS = 1 << 20, 1 << 23


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_bpe(model: bytes):
    """An encoder for a byte-level BPE tokenizer file whose ids rise in the order of its merges."""
    import tiktoken

    told = json.loads(model)
    if told["model"]["type"] != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space") or told.get("normalizer") or not told["pre_tokenizer"].get("use_regex", True):
        raise ValueError("not a plain byte-level BPE tokenizer")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    vocabulary = {w: i for w, i in told["model"]["vocab"].items() if w not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
    made = [vocabulary[m] for m in merges]
    if made != sorted(made) or len(made) + 256 != len(vocabulary):
        raise ValueError("ids don't rise in the order of the merges")
    ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
    # Fixed value: how byte-level BPE cuts text before merging.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(base64.b16encode(zlib.crc32(model).to_bytes(4)).decode(), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cuts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces whose ids don't depend on what is around them, and whether they may be encoded side by side.

    A run of white space gives its last space to the word after it, so a text may be
    cut before each space that a word follows.  Bytes that may start a white space
    beyond ASCII count as a word only after a plain letter or sign.
    """
    data = block.data
    maybe_space = np.zeros(256, bool)
    maybe_space[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    edge = np.zeros(len(data) + 1, bool)  # where documents start
    edge[block.offs] = True
    at = np.flatnonzero(data[1:-1] == 32) + 1
    after, before = data[at + 1], data[at - 1]
    start = edge[:-1].copy()
    start[at[(after > 32) & (~maybe_space[after] | ((before > 32) & (before < 128))) & ~edge[at + 1]]] = True
    starts = np.flatnonzero(start)
    following = data[np.minimum(starts + 1, len(data) - 1)]
    return starts, (data[starts] == 32) & (following > 32) & ~maybe_space[following] & ~edge[starts]


class Encoder:
    """Ids of blocks of documents, each followed by an id of its own."""

    def __init__(self, model: bytes, end: int):
        self.bpe, self.end = byte_bpe(model), end
        self.width = np.zeros(self.bpe.n_vocab, np.int64)
        for i in range(self.bpe.n_vocab):
            try:
                self.width[i] = len(self.bpe.decode_single_token_bytes(i))
            except KeyError:
                continue
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.full(1 << 16, self.end, np.int32), 1  # the first id is the end

    def add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def text_ids(self, data: bytes) -> np.ndarray:
        return np.array(self.bpe.encode(data.decode(), allowed_special="all", disallowed_special=()), np.int32)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and numbers of ids of new pieces; those that may stand side by side are encoded as one text."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        own, alone = np.flatnonzero(beside), np.flatnonzero(~beside)
        if len(own):
            bytes_of = ends[own] - starts[own]
            offs = np.concatenate([[0], np.cumsum(bytes_of)])
            ids = self.text_ids(data[np.arange(offs[-1]) + np.repeat(starts[own] - offs[:-1], bytes_of)].tobytes())
            ends_of = np.concatenate([[0], np.cumsum(self.width[ids])])
            bounds = np.searchsorted(ends_of, offs)
            if not np.array_equal(ends_of[bounds], offs):
                raise AssertionError("a token crosses a cut")
            at[own], size[own] = self.add(ids) + bounds[:-1], np.diff(bounds)
        for i in alone:
            ids = self.text_ids(data[starts[i] : ends[i]].tobytes())
            at[i], size[i] = self.add(ids), len(ids)
        return at, size

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the bounds of each document."""
        starts, beside = cuts(block) if len(block.data) else (np.zeros(0, np.int64), np.zeros(0, bool))
        ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
        if self.used > MOST_IDS:
            self.clear()
        # Pieces of the two kinds have keys of their own; no key is 0.
        key = mix64(spans_hash(block.data, starts, ends) + beside.astype(np.uint64) * np.uint64(GAMMA)) | np.uint64(1)
        slot = (key >> np.uint64(1)).astype(np.int64) & (SLOTS - 1)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(self.key[slot] != key)
        if len(new):
            _, one, of = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[one]
            at_one, size_one = self.learn(block.data, starts[one], ends[one], beside[one])
            at[new], size[new] = at_one[of], size_one[of]
            self.key[slot[one]], self.at[slot[one]], self.size[slot[one]] = key[one], at_one, size_one
        # Each document's end is a piece of one id, at place 0 of the pool.
        place = np.searchsorted(starts, block.offs[1:])
        at, size = np.insert(at, place, 0), np.insert(size, place, 1)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        return ids, total[np.concatenate([[0], place + np.arange(1, block.n + 1)])]


@cache
def encoder(model: bytes, end: int) -> Encoder:
    """One for each worker: what it has learned serves the worker's next tasks too."""
    return Encoder(model, end)


# -- best fit ---------------------------------------------------------------------------


class Placement:
    """Runs of pieces in the order by length: piece ``first + i`` goes to sequence ``sequence + i`` at ``offset``."""

    def __init__(self, runs: list[tuple[int, int, int]], n_sequences: int):
        table = np.array(sorted(runs), np.int64).reshape(-1, 3)
        self.first, self.sequence, self.offset = table.T.copy()
        self.n_sequences = n_sequences

    def __call__(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.first, rank, "right") - 1
        return self.sequence[run] + rank - self.first[run], self.offset[run]


def demand(length: int) -> np.ndarray:
    """Tokens, documents and attention cost of a piece."""
    return np.array([length, 1, length * length], np.int64)


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> Placement:
    """Where pieces go, longest first, given how many there are of each length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no rule {rule!r}")
    full, scale = np.array(capacity, np.int64), np.array(weights) / np.square(np.array(capacity, np.float64))
    # Classes of sequences with one residual: consecutive numbers from ``start`` on.
    start, many, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    runs: list[tuple[int, int, int]] = []
    opened = rank = 0

    def cost(residual: np.ndarray, item: np.ndarray) -> np.ndarray:
        if rule == "norm":
            return np.square(residual - item) @ scale
        return (residual * item) @ scale

    for length in sorted(counts, reverse=True):
        item, left = demand(length), int(counts[length])
        if (item > full).any():
            raise ValueError(f"no sequence can hold a piece of {length} tokens")
        while left:
            fit = np.flatnonzero((rest >= item).all(1))
            if not len(fit):
                # New sequences, each filled before the next: no other has room.
                k = int((full // np.maximum(item, 1)).min())
                for n, size in ((left // k, k), (1, left % k)):
                    if n and size:
                        runs += [(rank + i * n, opened, i * length) for i in range(size)]
                        start, many, rest = np.append(start, opened), np.append(many, n), np.vstack([rest, full - size * item])
                        opened, rank = opened + n, rank + n * size
                left = 0
                break
            costs = cost(rest[fit], item)
            best = int(costs.argmin())
            j = int(fit[best])
            # How many pieces one sequence takes before another of its class, or the next best class, is better.
            other = costs[best] if many[j] > 1 else np.delete(costs, best).min(initial=np.inf)
            k, now = 1, rest[j] - item
            while k < left and (now >= item).all() and cost(now, item) <= other:
                k, now = k + 1, now - item
            n = min(max(int(many[j]) - 1, 1), left // k)
            used = int(full[0] - rest[j, 0])
            runs += [(rank + i * n, int(start[j]), used + i * length) for i in range(k)]
            rank, left = rank + n * k, left - n * k
            if n < many[j]:
                start, many, rest = np.append(start, start[j] + n), np.append(many, many[j] - n), np.vstack([rest, rest[j]])
            many[j], rest[j] = n, now
        # Sequences without room for a token or a document are done.
        open_ = (rest > 0).all(1)
        start, many, rest = start[open_], many[open_], rest[open_]
    return Placement(runs, opened)


# -- Spark ------------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, model: bytes, end: int, tokens: int, text: str, key: str, with_ids: bool) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of the pieces of each document, with their ids if wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = encoder(shared.value, end)

        def work(block: Block, table: pa.Table) -> list:
            ids, bounds = own.encode(block)
            size = np.diff(bounds)
            n = -(-size // tokens)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = (size - 1) % tokens + 1  # the first piece; the others are full
            start = np.where(piece > 0, head[doc] + (piece - 1) * tokens, 0)
            length = np.where(piece > 0, tokens, head[doc])
            raw = memoryview(ids.astype("<u4")).cast("B")
            place = bounds[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(place.tolist(), (place + length).tolist(), strict=True)]
            out = [table.column("id").take(pa.array(doc)), piece.astype(np.int32), start, length, crc]
            return [*out, lists(ids, np.append(place, len(ids)), pa.int32())] if with_ids else out

        return work

    schema = f"id {kind_of(docs, key)}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_blocks(docs.select(quoted(key).alias("id"), quoted(text).alias("text")), "text", make, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = 2, tokens: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0), with_ids: bool = False) -> DataFrame:
    """Each piece's key, piece, start, length, ids_crc32, sequence_id and offset (and ids).

    ``tokenizer`` is a path that the driver can read.  Sequences hold at most
    ``tokens`` tokens, ``documents`` pieces and ``attention`` cost; by default the last
    two are what ``tokens`` allows anyway.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    capacity = (tokens, documents or tokens, attention or tokens * tokens)
    with open(tokenizer, "rb") as f:
        model = f.read()
    pieces = scratch.save(cut_pieces(docs, model, end, tokens, text, key, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to ``tokens``
    shared = spark.sparkContext.broadcast(best_fit(counts, capacity, rule, weights))
    order = [F.col("length").desc(), "id", "piece", "row"]
    slim = ranked(pieces.drop("ids"), scratch, order, "ordered")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value(batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    placed = map_arrow(slim, place, f"id {kind_of(docs, key)}, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long")
    if with_ids:
        placed = placed.join(pieces.select("row", "ids"), "row")
    return placed.drop("row").withColumnRenamed("id", key)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, documents) of ``pack(..., with_ids=True)``: whole sequences; ``documents`` are the pieces' keys, numbers, offsets and lengths."""
    part = F.struct("offset", quoted(key).alias("key"), "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))
