"""Packing of tokenised documents into training sequences by a configuration linear program."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from tracegraph.llm.tables import quoted, saved

CAPACITY = 1024
END = 2
# Rounds of the multiplicative weights, columns taken from one pricing, and learning rate.
ROUNDS = 160
COLUMNS = 16
RATE = 0.2

# Texts in these characters have the same words under both libraries' patterns.
PLAIN = re.compile(r"[\n\x20-\x7e¡-ɏ]*")


def load_encoder(vocabulary: str):
    """A function from text to ids, equal to what ``tokenizers`` gives for the JSON file.

    The same merges are applied by the faster ``tiktoken`` on texts of Latin letters;
    other texts, and texts with the string of an added token, go to ``tokenizers`` itself.
    """
    # Kept in the library's module, which outlives a task; workers run many tasks.
    loaded = tiktoken.__dict__.setdefault("_loaded_vocabularies", {})
    if vocabulary not in loaded:
        exact = Tokenizer.from_file(vocabulary)
        units = {chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None: b for b in range(256)}
        units.pop(None)
        spare = (b for b in range(256) if b not in units.values())
        units.update({chr(256 + k): b for k, b in enumerate(list(spare))})
        added = {t.content for t in exact.get_added_tokens_decoder().values()}
        ranks = {bytes(units[c] for c in word): i for word, i in exact.get_vocab().items() if word not in added}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("same", pat_str=words, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if PLAIN.fullmatch(text) and not any(a in text for a in added):
                return fast.encode_ordinary(text)
            return exact.encode(text, add_special_tokens=False).ids

        loaded[vocabulary] = encode
    return loaded[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth) of every document.

    A document is its ids and ``end``; null counts as empty. Documents longer than
    ``capacity`` are cut from the back, so only their first piece may be shorter.
    ``nth`` numbers the pieces of one length inside the task ``part``.
    """
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *[StructField(n, LongType()) for n in names]])

    def run(batches):
        encode, part, seen = load_encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                index, rows = [], []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([*encode(body or ""), end], dtype="<u4")
                    start, stop, k = 0, len(ids) % capacity or capacity, 0
                    while start < len(ids):
                        stop = min(stop, len(ids))
                        length = stop - start
                        rows.append((k, start, length, zlib.crc32(ids[start:stop].tobytes()), part, seen[length]))
                        index.append(i)
                        seen[length] += 1
                        start, stop, k = stop, stop + capacity, k + 1
                columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c) for c in columns]], ["doc_id", *names])

    return source.mapInArrow(run, schema)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the most value that fits into c, by dynamic programming over all lengths."""
    best = np.zeros(capacity + 1)
    for c in range(int(lengths[0]), capacity + 1):
        fitting = np.searchsorted(lengths, c, side="right")
        best[c] = max(best[c - 1], (values[:fitting] + best[c - lengths[:fitting]]).max())
    return best


def trace(best: np.ndarray, values: np.ndarray, lengths: np.ndarray, room: int, first: int | None) -> Counter:
    """A most valuable filling of ``room`` as length counts, with ``first`` in it."""
    filling = Counter()
    if first is not None:
        filling[int(lengths[first])] += 1
        room -= int(lengths[first])
    while room >= lengths[0]:
        fitting = np.searchsorted(lengths, room, side="right")
        options = values[:fitting] + best[room - lengths[:fitting]]
        k = int(options.argmax())
        if options[k] < best[room] - 1e-12:
            room -= 1
            continue
        filling[int(lengths[k])] += 1
        room -= int(lengths[k])
    return filling


def configurations(need: dict[int, int], capacity: int) -> list[tuple[Counter, float]]:
    """Fractional solution of the configuration program: fillings and how often to use each.

    The bound on sequences is fixed at total length over capacity; a weight per length
    falls exponentially with how well the length is covered so far, and a knapsack over
    the weights prices the next fillings.
    """
    lengths = np.array(sorted(need), dtype=np.int64)
    wanted = np.array([need[int(n)] for n in lengths], dtype=float)
    target = float((lengths * wanted).sum()) / capacity
    covered, use, step = np.zeros(len(lengths)), Counter(), target / (ROUNDS * COLUMNS)
    place = {int(n): i for i, n in enumerate(lengths)}
    for t in range(ROUNDS):
        ahead = covered / wanted - t / ROUNDS
        # Long pieces are worth more: at equal coverage a filling is worth its length.
        values = lengths * np.exp(-RATE * ROUNDS / 8 * np.clip(ahead, -0.5, 0.5))
        values = values / values.max()
        best = price(values, lengths, capacity)
        options = values + best[capacity - lengths]
        for k in np.argsort(-options, kind="stable")[:COLUMNS]:
            filling = trace(best, values, lengths, capacity, int(k))
            use[tuple(sorted(filling.items()))] += step
            for n, copies in filling.items():
                covered[place[n]] += copies * step
    return [(Counter(dict(f)), x) for f, x in use.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Fillings and how many sequences take each; together exactly the pieces of the histogram.

    The solution is rounded down: its fillings, most used first, are taken as often as
    the program says and the remaining pieces allow. What rounding leaves is placed best
    fit, longest first. Work depends on the number of lengths, not of pieces.
    """
    need = {n: k for n, k in histogram.items() if k > 0}
    chosen: list[tuple[Counter, int]] = []
    if need.get(capacity):
        chosen.append((Counter({capacity: 1}), need.pop(capacity)))
    if need:
        for filling, x in sorted(configurations(need, capacity), key=lambda f: (-f[1], sorted(f[0].items()))):
            times = min(int(x), *[need[n] // c for n, c in filling.items()])
            if times > 0:
                chosen.append((filling, times))
                for n, c in filling.items():
                    need[n] -= c * times
    return chosen + best_fit(need, capacity)


def best_fit(need: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, with equal sequences handled together."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    for n in sorted(need, reverse=True):
        left = need[n]
        while left > 0:
            room = min((r for r in open_bins if r >= n and open_bins[r]), default=None)
            if room is None:
                per = capacity // n
                full, rest = divmod(left, per)
                if full:
                    open_bins.setdefault(capacity - per * n, []).append((((n, per),), full))
                if rest:
                    open_bins.setdefault(capacity - rest * n, []).append((((n, rest),), 1))
                left = 0
            else:
                filling, count = open_bins[room].pop()
                used = min(count, left)
                if count > used:
                    open_bins[room].append((filling, count - used))
                grown = Counter(dict(filling))
                grown[n] += 1
                open_bins.setdefault(room - n, []).append((tuple(sorted(grown.items())), used))
                left -= used
    return [(Counter(dict(f)), count) for bins in open_bins.values() for f, count in bins]


def allocation(fillings: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For every length, which of its pieces (by rank) go to which sequences, as sorted columns."""
    rows, next_rank, sequence = [], Counter(), 0
    for filling, times in fillings:
        offset = 0
        for n, copies in sorted(filling.items(), reverse=True):
            rows.append((n, next_rank[n], copies, sequence, offset))
            next_rank[n] += copies * times
            offset += copies * n
        sequence += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), columns))


RANK_BITS = 44


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every id of every document is in exactly one piece, and pieces in a sequence follow
    each other without gaps from offset 0. Null and empty texts are the single id
    ``end``. Repeated rows and rows without an identifier are documents of their own.
    Only the histogram of lengths (at most ``capacity`` numbers) is gathered; pieces of
    one length are numbered by their task's first number plus their number in the task.
    """
    cut = saved(pieces(docs, vocabulary, text, doc_id, capacity, end), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = allocation(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = StructType([*ranked.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        keys = (where["length"] << RANK_BITS) + where["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1
            turn, slot = np.divmod(rank - where["rank"][row], where["copies"][row])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(where["sequence"][row] + turn), pa.array(where["offset"][row] + slot * length)], schema.fieldNames()
            )

    return ranked.mapInArrow(place, schema)
