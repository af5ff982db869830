"""Line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased).  Two lines match if the
Jaccard similarity of their sets is at least ``percent`` / 100; a line goes if
any earlier line of the table matches it.  Lines are ordered by document id, a
hash of the document's id and text, and line number.  Lines of fewer than
``least_words`` distinct words are neither compared nor removed; the default
compares all lines that have a word.

The join is the prefix-filter join of Xiao et al. ("Efficient similarity joins
for near-duplicate detection"): tokens in one order from rare to common,
posting lists over prefixes, then length filter, positional filter and a bound
on the symmetric difference from a parity sketch, then the exact similarity.
The order comes from token counts over all lines in ``2^SLOT_BITS`` hash slots,
a broadcast of fixed size: any order that all lines share is exact, counts only
make it selective.  Lines of equal sets are one class, so copies are not joined
but counted.

Pairs are never emitted.  Posting lists are dealt to tasks by token; a first
join finds the postings that have any candidate, and only these are dealt again
with their whole sets, which are cut from the text at the place of the class's
first line.  There every pair is checked once, in the list of its first common
token, and leaves only counts: each class's links, the lines behind them and the
earliest of them.  A list of more than ``most_postings`` entries is split into
fragments, and every two fragments meet in a task of their own.

Defined results: null text counts as empty and stays null; rows with equal id
and text are one document (nothing in one removes a line of the other); null ids
sort first; very long texts and lines are compared whole; an empty table gives
no rows; other columns pass through, and columns named like a result, in
whatever case, are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, blocks, fresh, in_filter, key_filter, lists, lower, map_arrow, map_blocks, mix64, others, quoted, set_digests, signed, spans_hash, words

SLOT_BITS = 22
#: Token counts travel as compressed pieces of the slot table.
PIECES = 64
#: Postings in a bucket of the first join, and bytes of sets in a bucket of the second.
BUCKET_POSTINGS, BUCKET_SET_BYTES = 100_000, 12 << 20
#: Buckets go to at most so many tasks, which take them one after another.
MOST_TASKS = 50_000
#: Posting lists that may be split, as a power of two: a list is split beyond this share of all postings at the latest.
MOST_SPLIT_BITS = 20
#: Places in the prefix up to which an earlier common token is looked for before the sets are intersected.
MOST_AHEAD = 16
#: Candidate pairs that a task looks at together.
PAIRS_AT_ONCE = 1 << 18


# -- lines and their tokens -------------------------------------------------------------


def line_sets(block: Block, codes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each compared line, rarest first by ``codes``; the lines' bounds, documents and numbers."""
    low = lower(block.data)
    starts, ends, doc = words(block, low)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), none, none
    breaks = np.flatnonzero(low == 10)
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]])))
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    line_doc, number = doc[first], line[first] - np.searchsorted(breaks, block.offs[doc[first]])
    size = np.diff(np.append(first, len(line)))
    raw, owner = spans_hash(low, starts, ends), np.repeat(np.arange(len(size)), size)
    code = codes[(raw & np.uint64(len(codes) - 1)).astype(np.int64)]
    # One sort by line, count and token; its key has as many bits of the token as fit.
    bits = int(len(size)).bit_length()
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (code.astype(np.uint64) << np.uint64(48 - bits)) | (raw >> np.uint64(16 + bits))
    order = np.argsort(key)
    token, key = raw[order], key[order]
    if ((key[1:] == key[:-1]) & (token[1:] != token[:-1])).any():
        order = np.lexsort((raw, code, owner))
        token = raw[order]
    owner = owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    size = np.bincount(owner, minlength=len(size))
    long = size >= least_words
    keep = np.repeat(long, size)
    return token[keep], np.concatenate([[0], np.cumsum(size[long])]), line_doc[long], number[long]


def chosen_lines(block: Block, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Block:
    """The lines that ``wanted`` chooses by document and number, each as a document of a new block."""
    breaks = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate([block.offs[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, block.offs[1:]]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(block.n), np.searchsorted(block.offs, breaks, "right") - 1]), kind="stable")
    keep = wanted(doc, np.arange(len(doc)) - np.searchsorted(doc, doc))
    size = (end - start)[keep]
    offs = np.concatenate([[0], np.cumsum(size)])
    return Block(block.data[np.arange(offs[-1]) + np.repeat(start[keep] - offs[:-1], size)], offs, 0)


def prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of which a match must share one; none where even a set of one more token that holds this one is too large to match."""
    return np.where(100 * size >= percent * (size + 1), size - (percent * size + 99) // 100 + 1, 0)


def parity(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits in two words, each the parity of the tokens that hash to it: two sets differ in no fewer tokens than bits."""
    if len(bounds) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = mix64(token ^ np.uint64(0x5BD1E9955BD1E995))
    bit, upper = np.uint64(1) << (h >> np.uint64(58)), (h & np.uint64(1)).astype(bool)
    return tuple(np.bitwise_xor.reduceat(np.where(upper == half, bit, np.uint64(0)), bounds[:-1]) for half in (False, True))


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(quoted(key).cast("long").alias("id"), F.xxhash64(quoted(key).cast("long"), quoted(text)).alias("h"), quoted(text).alias("text"))


def token_codes(lines: DataFrame) -> np.ndarray:
    """A code for each hash slot that rises with the number of words in it: the number up to 4096, then its logarithm."""
    each = (1 << SLOT_BITS) // PIECES
    codec = "zstd"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                low = lower(block.data)
                starts, ends, _ = words(block, low)
                np.add.at(total, (spans_hash(low, starts, ends) & np.uint64(len(total) - 1)).astype(np.int64), 1)
        pieces = [pa.compress(total[i * each : (i + 1) * each].tobytes(), codec, asbytes=True) for i in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.array(pieces, pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(pa.decompress(counts.as_buffer(), 8 * each, codec), np.int64)
                sums[piece] = sums[piece] + got if piece in sums else got
        made = []
        for n in sums.values():
            code = np.minimum(n, 4096) + (256 * np.log2(np.maximum(n, 4096) / 4096)).astype(np.int64)
            made.append(np.minimum(code, 65535).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(made, pa.binary())], names=["piece", "codes"])

    counted = map_arrow(lines.select("text"), count, "piece long, counts binary").repartition(PIECES, "piece")
    out = np.zeros(1 << SLOT_BITS, np.uint16)
    for row in map_arrow(counted, add, "piece long, codes binary").toArrow().to_pylist():
        out[row["piece"] * each : (row["piece"] + 1) * each] = np.frombuffer(row["codes"], np.uint16)
    return out


def index_lines(lines: DataFrame, shared, least_words: int, percent: int) -> DataFrame:
    """Every compared line with its digest, place, size, sketch and those prefix tokens that occur elsewhere."""

    def make():
        codes = shared.value

        def work(block: Block, table: pa.Table) -> list:
            token, bounds, doc, number = line_sets(block, codes, least_words)
            size = np.diff(bounds)
            at = np.arange(len(token)) - np.repeat(bounds[:-1], size)
            owner = np.repeat(np.arange(len(size)), size)
            chosen = (at < prefix_sizes(size, percent)[owner]) & (codes[(token & np.uint64(len(codes) - 1)).astype(np.int64)] > 1)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[chosen], minlength=len(size)))])
            d1, d2 = set_digests(token, bounds)
            s1, s2 = parity(token, bounds)
            rows = pa.array(doc)
            return [signed(d1), signed(d2), table.column("id").take(rows), table.column("h").take(rows), number.astype(np.int32), size.astype(np.int32), signed(s1), signed(s2), lists(signed(token[chosen]), cuts, pa.int64()), lists(at[chosen].astype(np.int32), cuts, pa.int32())]

        return work

    return map_blocks(lines, "text", make, "d1 long, d2 long, id long, h long, line int, n int, s1 long, s2 long, tokens array<long>, at array<int>")


# -- posting lists ----------------------------------------------------------------------


def candidate_pairs(token: np.ndarray, tile: np.ndarray, piece: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings of one list that pass the length, positional and sketch filters, in bounded portions.

    Postings of a split list meet in the tile of their two fragments only
    (``tile`` names it, ``piece`` is the posting's fragment).
    """
    if not len(token):
        return
    order = by_list(token, tile, n)
    token, tile, piece, n = token[order], tile[order], piece[order], n[order].astype(np.int64)
    rest, sketch = n - at[order], [s[order] for s in sketch]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])
    run, top = np.cumsum(new), int(n.max()) + 1
    last = np.searchsorted(run * top + n, run * top + np.minimum(100 * n // percent, top - 1), "right")
    # Partners are no smaller, so the first common token is among the few that a match of two sets of this size must leave.
    indexed = at[order] <= n - (2 * percent * n + 99 + percent) // (100 + percent)
    many = np.where(indexed, last - np.arange(len(last)) - 1, 0)
    total, place = np.concatenate([[0], np.cumsum(many)]), 0
    split = bool((tile >= 0).any())
    while place < len(many):
        # A posting has no more partners than its list, whose length is bounded.
        end = max(place + 1, int(np.searchsorted(total, total[place] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(place, end), many[place:end])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[place])
        fit = np.flatnonzero((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (n[i] + n[j]))
        i, j = i[fit], j[fit]
        most = n[i] + n[j] - 2 * ((percent * (n[i] + n[j]) + 99 + percent) // (100 + percent))
        fit = sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sketch) <= most
        if split:
            fit &= (tile[i] < 0) | (piece[i] != piece[j]) | (tile[i] >> 32 == (tile[i] & 0xFFFFFFFF))
        if fit.any():
            yield order[i[fit]], order[j[fit]]
        place = end


def by_list(token: np.ndarray, tile: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Order by tile, token and size."""
    if (tile < 0).all() and n.max() < 1 << 16:
        key = (token.view(np.uint64) >> np.uint64(16) << np.uint64(16)) | n.astype(np.uint64)
        order = np.argsort(key)
        key, token = key[order] >> np.uint64(16), token[order]
        if not ((key[1:] == key[:-1]) & (token[1:] != token[:-1])).any():  # else two tokens agree in their first 48 bits
            return order
    return np.lexsort((n, token, tile))


def posting_rows(classes: DataFrame, hot: dict[int, int], n_buckets: int) -> DataFrame:
    """The classes' postings, dealt by token to buckets; each row packs those of many classes for one bucket.

    ``hot`` has the number of fragments of each list that is split.
    """
    names = np.array(sorted(hot), np.int64)
    pieces = np.array([hot[int(t)] for t in names], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def deal() -> pa.RecordBatch:
            flat = [np.concatenate(x) for x in zip(*held, strict=True)]
            bucket = bucket_of(flat[0], flat[1], n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            cuts = np.append(first, len(bucket))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(used), *(lists(x[order], cuts, k) for x, k in zip(flat, kinds, strict=True))], names=["bucket", "token", "tile", "piece", "number", "n", "at", "s1", "s2"])

        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            many = column["tokens"].value_lengths().to_numpy()
            token, at = column["tokens"].flatten().to_numpy(), column["at"].flatten().to_numpy()
            own = np.repeat(np.arange(len(many)), many)
            rest = [column[c].to_numpy()[own] for c in ("number", "n")]
            ends = [column[c].to_numpy()[own] for c in ("s1", "s2")]
            tile, piece = np.full(len(token), -1, np.int64), np.zeros(len(token), np.int32)
            if len(names):
                place = np.minimum(np.searchsorted(names, token), len(names) - 1)
                split = np.flatnonzero(names[place] == token)
                parts = pieces[place[split]]
                mine = (mix64(rest[0][split]) % parts.astype(np.uint64)).astype(np.int64)
                # A posting of fragment f goes to the tiles (0, f) ... (f, f) ... (f, last).
                copy = np.repeat(np.arange(len(split)), parts)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(parts) - parts, parts)
                take = np.concatenate([np.delete(np.arange(len(token)), split), split[copy]])
                tiles = (np.minimum(mine[copy], other) << 32) | np.maximum(mine[copy], other)
                tile, piece = np.concatenate([tile[: len(token) - len(split)], tiles]), np.concatenate([piece[: len(token) - len(split)], mine[copy].astype(np.int32)])
                token, at, rest, ends = token[take], at[take], [x[take] for x in rest], [x[take] for x in ends]
            held.append([token, tile, piece, rest[0], rest[1], at, *ends])
            size += len(token)
            if size >= 2 * BUCKET_POSTINGS:
                yield deal()
                held, size = [], 0
        if size:
            yield deal()

    schema = "bucket long, token array<long>, tile array<long>, piece array<int>, number array<long>, n array<int>, at array<int>, s1 array<long>, s2 array<long>"
    return map_arrow(classes.select("number", "n", "s1", "s2", "tokens", "at"), run, schema)


def bucket_of(token: np.ndarray, tile: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix64(mix64(token) + tile.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def active_postings(postings: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """(number, token, tile, piece, at) of the postings with a candidate in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            token, tile, piece, number, n, at, s1, s2 = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("token", "tile", "piece", "number", "n", "at", "s1", "s2"))
            active = np.zeros(len(token), bool)
            for i, j in candidate_pairs(token, tile, piece, n, at, [s1.view(np.uint64), s2.view(np.uint64)], percent):
                active[i] = active[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[active]) for x in (number, token, tile, piece, at)], names=["number", "token", "tile", "piece", "at"])

    return map_arrow(dealt(postings, n_buckets), run, "number long, token long, tile long, piece int, at int")


def dealt(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows with their buckets together, each bucket in one task."""
    return rows.repartition(min(n_buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and a < b and held[-1].column("bucket")[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def hot_tokens(classes: DataFrame, codes: np.ndarray, shared, most_postings: int) -> dict[int, int]:
    """Fragments of each posting list of more than ``most_postings`` entries, from exact counts.

    Only slots with that many words can hold such a token, so the counting job
    runs only where there are any.  The caller sees to it that there are no more
    than ``2^MOST_SPLIT_BITS`` such lists.
    """
    limit = np.uint16(min(most_postings, 4095))
    if codes.max() <= limit:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            token = batch.column(0).flatten().to_numpy()
            own, n = np.unique(token[codes[token & (len(codes) - 1)] > limit], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["token", "n"])

    counted = map_arrow(classes.select("tokens"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > most_postings)
    return {r.token: -(-r.n // most_postings) for r in counted.collect()}


# -- exact similarity -------------------------------------------------------------------


def sets_at(lines: DataFrame, shared, places, least_words: int) -> DataFrame:
    """(d1, d2, s): the sets, rarest token first, of the lines whose place (the document's hash and the line's number) may be in the filter ``places``."""

    def make():
        codes, bits = shared.value, places.value

        def work(block: Block, table: pa.Table) -> list:
            h = table.column("h").to_numpy()

            def wanted(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
                return in_filter(bits, h[doc] ^ number)

            token, bounds, _, _ = line_sets(chosen_lines(block, wanted), codes, least_words)
            d1, d2 = set_digests(token, bounds)
            return [signed(d1), signed(d2), lists(signed(token), bounds, pa.int64())]

        return work

    return map_blocks(lines, "text", make, "d1 long, d2 long, s array<long>")


def confirmed_links(rows: DataFrame, shared, n_buckets: int, percent: int) -> DataFrame:
    """Of each class, in each task: its links, the lines behind them and the earliest place of a linked class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            yield of_bucket(table)

    def of_bucket(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in table.column_names if c != "s"}
        number, token, tile, piece, at = (column[c].to_numpy() for c in ("number", "token", "tile", "piece", "at"))
        # A row comes again where its first line does; lists of one token hold a class once.
        order = np.lexsort((number, token, tile))
        again = np.zeros(len(number), bool)
        again[1:] = (number[order][1:] == number[order][:-1]) & (token[order][1:] == token[order][:-1]) & (tile[order][1:] == tile[order][:-1])
        row = order[~again]
        own, first, cls = np.unique(number[row], return_index=True, return_inverse=True)
        take = row[first]
        sets = table.column("s").take(pa.array(take)).combine_chunks()
        size = sets.value_lengths().to_numpy().astype(np.int64)
        flat = sets.flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(size)])
        sketch = parity(flat.view(np.uint64), bounds)
        _, local = np.unique(flat, return_inverse=True)
        width = int(local.max()) + 1
        local_sorted, spot = sorted_members(local, bounds)
        ahead = np.full((len(own), min(int(at.max()), MOST_AHEAD)), -1, np.int32)  # each class's rarest tokens
        inside = np.arange(ahead.shape[1]) < size[:, None]
        ahead[inside] = local[(bounds[:-1, None] + np.arange(ahead.shape[1]))[inside]]
        place = column["place"].take(pa.array(take))
        ident, h, line = (place.field(c) for c in ("id", "h", "line"))
        known = (~np.asarray(ident.is_null())).astype(np.int8)
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((line.to_numpy(), h.to_numpy(), ident.fill_null(0).to_numpy(), known))] = np.arange(len(own))
        at_rank = np.argsort(rank)
        copies = column["copies"].take(pa.array(take)).to_numpy()
        links, linked, earliest = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.full(len(own), len(own))
        for i, j in candidate_pairs(token[row], tile[row], piece[row], size[cls], at[row], [s[cls] for s in sketch], percent):
            first = ~shared_ahead(ahead, cls[i], at[row[i]], cls[j], at[row[j]])
            i, j = i[first], j[first]
            for low in range(0, len(i), step := max(1, (1 << 20) // max(int(size.max()), 1))):
                x, y, spot_x = cls[i[low : low + step]], cls[j[low : low + step]], at[row[i[low : low + step]]]
                pair_x, of_x = spread(bounds, x)
                pair_y, of_y = spread(bounds, y)
                key_x, key_y = pair_x * width + local_sorted[of_x], pair_y * width + local_sorted[of_y]
                hit = np.minimum(np.searchsorted(key_y, key_x), len(key_y) - 1)
                common = key_y[hit] == key_x
                shared_tokens = np.bincount(pair_x[common], minlength=len(x))
                lowest = np.full(len(x), 1 << 62)
                np.minimum.at(lowest, pair_x[common], spot[of_x][common])
                good = (lowest == spot_x) & (100 * shared_tokens >= percent * (size[x] + size[y] - shared_tokens))
                x, y = x[good], y[good]
                for a, b in ((x, y), (y, x)):
                    links += np.bincount(a, minlength=len(own))
                    np.add.at(linked, a, copies[b])
                    np.minimum.at(earliest, a, rank[b])
        some = np.flatnonzero(links)
        other = place.take(pa.array(at_rank[earliest[some]]))
        return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(links[some]), pa.array(linked[some]), *(other.field(c) for c in ("id", "h", "line"))], names=["number", "links", "linked", "id", "h", "line"])

    return map_arrow(dealt(rows, n_buckets), run, "number long, links long, linked long, id long, h long, line int")


def sorted_members(local: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of each run in ascending order, and where in the run each stood."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    spot = np.arange(len(local)) - bounds[owner]
    a, b = int(size.max()).bit_length(), int(local.max()).bit_length()
    if int(len(size)).bit_length() + a + b < 63:
        key = np.sort((owner << (a + b)) | (local << a) | spot)
        return (key >> a) & ((1 << b) - 1), key & ((1 << a) - 1)
    by = np.lexsort((local, owner))
    return local[by], spot[by]


def shared_ahead(ahead: np.ndarray, x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Whether two classes share one of the ``ahead`` tokens before the places ``at_x`` and ``at_y``."""
    out = np.zeros(len(x), bool)
    for k in range(int(min(at_x.max(initial=0), ahead.shape[1]))):
        own = np.flatnonzero((at_x > k) & (at_y > 0) & ~out)
        theirs = np.arange(ahead.shape[1]) < at_y[own, None]
        out[own] = ((ahead[y[own]] == ahead[x[own], k][:, None]) & theirs).any(1)
    return out


def spread(bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs ``own``: the place in ``own`` and the index of each of their members."""
    size = bounds[own + 1] - bounds[own]
    pair = np.repeat(np.arange(len(own)), size)
    return pair, np.arange(len(pair)) + np.repeat(bounds[own] - (np.cumsum(size) - size), size)


# -- the operator -----------------------------------------------------------------------


def line_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, least_words: int = 1, most_postings: int = 100_000) -> DataFrame:
    """(id, h, line, class_id, copies, linked_classes, linked_lines, gone) of every compared line that has a copy or a link.

    A class is the lines of one token set and ``copies`` their number, lines of
    equal rows included; its links are the other classes that match it, and
    ``linked_lines`` the sum of their copies.  ``gone`` lines have an earlier
    line in their class or in a linked one.  A line that isn't listed is a class
    of its own without links.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "line-dedup")
    lines = _lines(docs, text, key)
    codes = token_codes(lines)
    shared = spark.sparkContext.broadcast(codes)
    indexed = scratch.save(index_lines(lines, shared, least_words, percent), "indexed")
    place = F.struct("id", "h", "line")
    classes = indexed.groupBy("d1", "d2").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first(F.struct("n", "s1", "s2", "tokens", "at")).alias("own"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("number"), "d1", "d2", "place", "copies", "own.*"), "classes")
    places = scratch.save(indexed.select("d1", "d2", "id", "h", "line"), "places")
    scratch.drop("indexed")

    n_postings = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_buckets = max(n_postings // BUCKET_POSTINGS + 1, spark.sparkContext.defaultParallelism)
    postings = posting_rows(classes, hot_tokens(classes, codes, shared, max(most_postings, n_postings >> MOST_SPLIT_BITS)), n_buckets)
    active = scratch.save(active_postings(postings, n_buckets, percent), "active")
    firsts = classes.join(active.select("number").distinct(), "number", "left_semi").select("number", "d1", "d2", "place", "copies", "n")
    firsts = scratch.save(firsts, "firsts")
    bits = spark.sparkContext.broadcast(key_filter(firsts.select(F.col("place.h").bitwiseXOR(F.col("place.line").cast("long")).alias("k"))))
    sets = sets_at(lines, shared, bits, least_words).join(firsts, ["d1", "d2"]).select("number", "place", "copies", "s")
    n_bytes = active.join(firsts.select("number", "n"), "number").agg(F.sum(8 * F.col("n") + 80)).first()[0] or 0
    n_buckets = max(n_bytes // BUCKET_SET_BYTES + 1, spark.sparkContext.defaultParallelism)
    rows = active.withColumn("bucket", F.pmod(F.xxhash64("token", "tile"), F.lit(n_buckets))).join(sets, "number")
    links = confirmed_links(rows, shared, n_buckets, percent)
    other = F.min(F.struct("id", "h", "line")).alias("other")
    links = scratch.save(links.groupBy("number").agg(F.sum("links").alias("linked_classes"), F.sum("linked").alias("linked_lines"), other), "links")
    scratch.drop("active", "firsts")

    known = classes.select("number", "d1", "d2", "place", "copies").join(links, "number", "left").where("copies > 1 or linked_classes > 0")
    known = known.select("d1", "d2", F.least("place", F.coalesce("other", "place")).alias("earliest"), "copies", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("linked_classes", "linked_lines")))
    found = places.join(known, ["d1", "d2"])
    class_id = F.lower(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))).alias("class_id")
    out = scratch.save(found.select("id", "h", "line", class_id, "copies", "linked_classes", "linked_lines", (F.col("earliest") < place).alias("gone")), "lines")
    scratch.drop("classes", "places", "links")
    return out


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with repeated lines cut from the text, and n_lines, n_removed and line_classes: each line with a copy or a link, its class and the class's links."""
    of_lines = line_classes(docs, text, key, **options)
    of_id, of_text, found_lines, cut = fresh(docs, "id", "h", "lines", "cut")
    each = F.sort_array(F.collect_set(F.struct("line", "class_id", "copies", "linked_classes", "linked_lines", "gone")))
    found = of_lines.groupBy("id", "h").agg(each.alias(found_lines)).withColumnsRenamed({"id": of_id, "h": of_text})
    own = quoted(key).cast("long")
    # Hashing the lines' side spares a sort of all texts.
    joined = docs.join(found.hint("shuffle_hash"), own.eqNullSafe(F.col(of_id)) & (F.xxhash64(own, quoted(text)) == F.col(of_text)), "left")
    joined = joined.withColumn(cut, F.transform(F.filter(found_lines, lambda x: x["gone"]), lambda x: x["line"]))
    parts = F.split(quoted(text), "\n", -1)
    # The outer transform binds the lines, so that they are cut out once and not for each line.
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut)), lambda i: F.get(lines, i))
    rest = F.array_join(F.flatten(F.transform(F.array(parts), stay)), "\n")
    cleaned = F.when(F.size(cut) > 0, rest).otherwise(quoted(text)).alias(text)
    names = others(docs, "n_lines", "n_removed", "line_classes")
    breaks = F.octet_length(quoted(text)) - F.octet_length(F.replace(quoted(text), F.lit("\n"), F.lit("")))
    counts = (F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed"))
    return joined.select(*(cleaned if c == text else quoted(c) for c in names), *counts, F.coalesce(found_lines, F.array().cast(found.schema[found_lines].dataType)).alias("line_classes"))
