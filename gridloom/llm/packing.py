"""Filling fixed-capacity containers with items, by exact-complement hashing.

Only the histogram of lengths, no longer than the capacity, comes to the driver. There
patterns are made: a container is begun with the longest item left and filled with the
longest that fit; as soon as one, two or three lengths left sum exactly to the gap - by
an index of single, pair and triple sums - they close it, as often as counts allow. What
no combination closes is filled best-fit. Items then find their places by their rank
within their length, in the executors.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import pick
from gridloom.functions.ranking import ranked
from gridloom.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text into the pieces over which byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pieces as the tokenizer finds them, whose white space is that of Unicode.
_PIECE = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
#: Longer texts are tokenized in segments of about so many characters, cut between pieces: the tokenizer's own search gives up on very long runs of white space.
SEGMENT = 500_000


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    enc = encoding(path)
    if len(text) <= SEGMENT:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    for m in _PIECE.finditer(text):
        if m.end() - m.start() > SEGMENT:
            n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(m[0]))
            at = m.end()
        elif m.end() - at >= SEGMENT:
            n += len(enc.encode_ordinary(text[at : m.end()]))
            at = m.end()
    return n + len(enc.encode_ordinary(text[at:]))


def token_lengths(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of each distinct document; null texts have no tokens."""
    docs = pick(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "text_hash", "n_tokens"])

    return spread(docs).mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_tokens bigint").distinct()


class Sums:
    """Which lengths are left, and which totals two and three of them reach: bit t for total t."""

    def __init__(self, left: Counter, capacity: int):
        self.left, self.full = left, (1 << (capacity + 1)) - 1
        self.ones = sum(1 << x for x in left)
        self._twos: int | None = None

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.ones &= ~(1 << length)
            self._twos = None

    def put(self, length: int, n: int = 1) -> None:
        if length not in self.left:
            self.ones |= 1 << length
            self._twos = None
        self.left[length] += n

    @property
    def twos(self) -> int:
        if self._twos is None:
            total = 0
            for x in self.left:
                total |= self.ones << x
            self._twos = total & self.full
        return self._twos

    def longest(self, most: int) -> int:
        """The longest length left of at most ``most``, or 0."""
        return max((self.ones & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        a = self.longest(gap - 1)
        while a * 2 >= gap and a:
            b = gap - a
            if self.ones >> b & 1 and (a != b or self.left[a] > 1):
                return a, b
            a = self.longest(a - 1)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that sum to the gap, the longest first."""
        if self.ones >> gap & 1:
            return (gap,)
        if self.twos >> gap & 1 and (found := self.pair(gap)):
            return found
        a = self.longest(gap - 2)
        while a * 3 >= gap and a:
            if self.twos >> (gap - a) & 1:
                self.left[a] -= 1  # for a while, for the counts; the sums stay as they are
                found = self.pair(gap - a)
                ok = found and all(self.left[x] >= n for x, n in Counter(found).items())
                self.left[a] += 1
                if ok:
                    return (a, *found)
            a = self.longest(a - 1)
        return None


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers), using up ``counts`` (length -> items, 1 to capacity).

    Each pattern is used until some length x has fewer items left than it holds, at most
    capacity / x; so there are about capacity x ln(capacity) patterns at most, however
    many items.
    """
    sums = Sums(Counter({x: n for x, n in counts.items() if n > 0}), capacity)
    made = []
    while sums.left:
        held: list[int] = []
        gap = capacity
        while gap:
            closing = sums.exact(gap) if held else None
            if closing is None:
                longest = sums.longest(gap)
                closing = (longest,) if longest else ()
            if not closing:
                break
            for x in closing:
                sums.take(x)
            held += closing
            gap -= sum(closing)
        uses = Counter(held)
        for x, n in uses.items():
            sums.put(x, n)
        times = min(sums.left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            sums.take(x, n * times)
        made.append((tuple(sorted(held, reverse=True)), times))
    return made


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first container, position, token offset) of each place of each pattern."""
    used: Counter = Counter()
    out, container = [], 0
    for held, times in made:
        offset = 0
        for position, x in enumerate(held):
            out.append((x, used[x], container, position, offset))
            used[x] += times
            offset += x
        container += times
    return out


def pack(lengths: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_kind, container_id, position, token_offset, doc_id, text_hash, piece, token_start, n_tokens).

    lengths: from ``token_lengths``; capacities: (container_kind, capacity_tokens), few
    rows; null capacities and ones below 1 are left out. Every document is packed once
    for each kind. A text longer than the capacity is cut into full pieces and a rest,
    by token places; no other text is cut. A text without tokens gets a row with null
    container. Equal rows of ``lengths`` count once.
    """
    spark = lengths.sparkSession
    kinds = sorted((r.container_kind, r.capacity_tokens) for r in capacities.select("container_kind", "capacity_tokens").distinct().collect() if r.container_kind is not None and (r.capacity_tokens or 0) > 0)
    if not kinds:
        return spark.createDataFrame([], f"container_kind string, container_id bigint, position int, token_offset int, doc_id {lengths.schema['doc_id'].dataType.simpleString()}, text_hash bigint, piece bigint, token_start bigint, n_tokens bigint")
    entries = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for i, (k, c) in enumerate(kinds)])
    each = lengths.distinct().select("doc_id", "text_hash", F.col("n_tokens").alias("total"), F.inline(entries))
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0))
    pieces = each.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.withColumn("token_start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least(F.col("capacity"), F.col("total") - F.col("token_start")))
    pieces = cut(pieces.select("kind", "container_kind", "doc_id", "text_hash", "piece", "token_start", "n_tokens", (F.col("kind") * (1 << 32) + F.col("n_tokens")).alias("bin")))
    histogram: dict[int, dict[int, int]] = {}
    for r in pieces.where("n_tokens > 0").groupBy("kind", "n_tokens").count().collect():
        histogram.setdefault(r["kind"], {})[r["n_tokens"]] = r["count"]
    table = sorted((k << 32 | x, first, container, position, offset) for k, counts in histogram.items() for x, first, container, position, offset in slots(patterns(counts, kinds[k][1])))
    places = np.array(table, dtype=np.int64).reshape(-1, 5)
    starts = np.searchsorted(places[:, 0], np.unique(places[:, 0])) if len(places) else np.array([], dtype=np.int64)
    shared = spark.sparkContext.broadcast((np.unique(places[:, 0]), np.append(starts, len(places)), places))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, starts, places = shared.value
        for b in batches:
            which, rank = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            at = np.zeros(len(which), dtype=np.int64)
            order = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    k = np.searchsorted(bins, which[rows[0]])
                    lo, hi = starts[k], starts[k + 1]
                    at[rows] = lo + np.searchsorted(places[lo:hi, 1], rank[rows], side="right") - 1
            got = places[at]
            cols = [b.column(c) for c in ("container_kind", "doc_id", "text_hash", "piece", "token_start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(got[:, 2] + rank - got[:, 1]), pa.array(got[:, 3].astype(np.int32)), pa.array(got[:, 4].astype(np.int32)), *cols[1:]], names=["container_kind", "container_id", "position", "token_offset", "doc_id", "text_hash", "piece", "token_start", "n_tokens"])

    kind = lengths.schema["doc_id"].dataType.simpleString()
    schema = f"container_kind string, container_id bigint, position int, token_offset int, doc_id {kind}, text_hash bigint, piece bigint, token_start bigint, n_tokens bigint"
    placed = ranked(pieces.where("n_tokens > 0"), "bin", ["doc_id", "text_hash", "piece"]).mapInArrow(place, schema)
    empty = pieces.where("n_tokens = 0").select("container_kind", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("token_offset"), "doc_id", "text_hash", "piece", "token_start", "n_tokens")
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, unused tokens, and the fewest containers that could hold the tokens."""
    held = packed.where("container_id is not null").groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    joined = held.join(capacities, "container_kind")
    return joined.select("container_kind", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", (F.col("n_containers") * F.col("capacity_tokens") - F.col("n_tokens")).alias("unused_tokens"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest_containers"))
