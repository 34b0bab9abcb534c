"""Benchmark passages found in training text with a BM25 index of the test items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tracegraph.llm.tables import keep_texts, quoted
from tracegraph.llm.words import bare_words, chained

SHINGLE = 5
# Shares of an item's shingles that must lie in one passage: of all, and of its question
# (first half) and answer (second half) each.
OVERLAP = 0.8
PART_OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 16
# Items in one index; a larger benchmark is searched index by index.
SHARD_ITEMS = 4096


@dataclass
class Index:
    """Postings of the test items, with impacts scaled so that an item matches from 1 on."""

    ids: list
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # where each term's postings begin
    items: np.ndarray  # ascending inside a term
    impacts: np.ndarray
    most: np.ndarray  # largest impact of each term
    block_first: np.ndarray  # where each term's blocks begin
    block_most: np.ndarray
    essential: np.ndarray  # terms without which no item can match
    rest: np.ndarray  # what the other terms can add at most, per item
    shingles: list
    passage: int  # words by which passages move on; they are twice as long


def build_index(ids: list, texts: list[str | None]) -> Index | None:
    """The index of all items with at least one word, or None.

    An item of n shingles still passes the check with up to (1 - OVERLAP) n of them lost,
    and each lost word loses at least one. Impacts are divided by what is left of an
    item's score after losing so many of its heaviest words, so retrieval at 1 misses
    nothing that the check would accept.
    """
    words = [bare_words(t) for t in texts]
    kept = [i for i, w in enumerate(words) if len(w)]
    if not kept:
        return None
    ids, words = [ids[i] for i in kept], [words[i] for i in kept]
    bags = [np.unique(w, return_counts=True) for w in words]
    terms, df = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True)
    idf = np.log(1 + (len(words) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(w) for w in words])
    rows = []
    shingles = []
    for k, (w, (own, tf)) in enumerate(zip(words, bags)):
        width = min(SHINGLE, len(w))
        grams = chained(w, width)
        shingles.append((width, grams, (len(grams) + 1) // 2))
        at = np.searchsorted(terms, own)
        impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        lost = int((1 - OVERLAP) * len(grams) + 1e-9)
        left = impact.sum() - np.sort(impact)[::-1][:lost].sum()
        rows.append(np.stack([at, np.full(len(at), k), impact / max(left * (1 - 1e-9), 1e-12)]))
    table = np.concatenate(rows, axis=1)
    table = table[:, np.lexsort((table[1], table[0]))]
    at, items, impacts = table[0].astype(np.int64), table[1].astype(np.int64), table[2]
    first = np.searchsorted(at, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(impacts, first[:-1])
    block_first, block_most = [0], []
    for t in range(len(terms)):
        own = impacts[first[t] : first[t + 1]]
        block_most += [own[i : i + BLOCK].max() for i in range(0, len(own), BLOCK)]
        block_first.append(len(block_most))
    # The commonest terms that together cannot carry any item over the threshold.
    rest, essential = np.zeros(len(ids)), np.ones(len(terms), dtype=bool)
    for t in np.argsort(-(first[1:] - first[:-1]), kind="stable"):
        own = slice(first[t], first[t + 1])
        if (rest[items[own]] + impacts[own] >= 0.5).any():
            break
        rest[items[own]] += impacts[own]
        essential[t] = False
    longest = max(len(w) for w in words)
    return Index(ids, terms, first, items, impacts, most, np.array(block_first), np.array(block_most), essential, rest, shingles, max(longest, SHINGLE))


def term_numbers(index: Index, words: np.ndarray) -> np.ndarray:
    """The index's number of each word, -1 for words it lacks."""
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    return np.where(index.terms[at] == words, at, -1)


def possible(index: Index, terms: np.ndarray) -> bool:
    """Whether any item could match a passage made of these distinct terms.

    Sums the impacts of the essential terms exactly and takes the others' bound.
    """
    own = terms[index.essential[terms]]
    counts = index.first[own + 1] - index.first[own]
    if not counts.sum():
        return bool((index.rest >= 1).any())
    at = np.repeat(index.first[own] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    sums = np.bincount(index.items[at], weights=index.impacts[at], minlength=len(index.ids))
    return bool((sums + index.rest >= 1).any())


def block_max_wand(index: Index, terms: np.ndarray, threshold: float = 1.0) -> list[tuple[int, float]]:
    """All (item, score) with at least ``threshold`` for the distinct query terms.

    Cursors move over the postings; the pivot is the first item whose terms' largest
    impacts reach the threshold, blocks whose maxima cannot reach it are passed over.
    """
    cursors = [[int(index.first[t]), int(index.first[t + 1]), int(t)] for t in terms]
    found, items, impacts = [], index.items, index.impacts

    def forward(cursor, item):
        cursor[0] += int(np.searchsorted(items[cursor[0] : cursor[1]], item))

    while True:
        cursors = sorted((c for c in cursors if c[0] < c[1]), key=lambda c: items[c[0]])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += index.most[c[2]]
            if bound >= threshold:
                pivot = k
                break
        if pivot is None:
            return found
        item = items[cursors[pivot][0]]
        while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == item:
            pivot += 1
        ahead = cursors[: pivot + 1]
        for c in ahead:
            forward(c, item)
        tops, ends = 0.0, []
        for start, stop, t in ahead:
            if start < stop:
                block = (start - index.first[t]) // BLOCK
                tops += index.block_most[index.block_first[t] + block]
                last = min(index.first[t] + (block + 1) * BLOCK, stop) - 1
                ends.append(items[last])
        if tops < threshold:
            following = min([*(e + 1 for e in ends), *(items[c[0]] for c in cursors[pivot + 1 :])], default=item + 1)
            for c in ahead:
                forward(c, max(following, item + 1))
            continue
        score = sum(impacts[c[0]] for c in ahead if c[0] < c[1] and items[c[0]] == item)
        if score >= threshold:
            found.append((int(item), float(score)))
        for c in ahead:
            forward(c, item + 1)


def matches(index: Index, text: str | None) -> list[tuple]:
    """(item number, score, overlap, question overlap, answer overlap) of a whole text, each item once.

    Every passage of the text is a query, unless all its terms together cannot match.
    """
    words = bare_words(text)
    numbers = term_numbers(index, words)
    if not possible(index, np.unique(numbers[numbers >= 0])):
        return []
    best: dict[int, tuple] = {}
    for at in range(0, max(1, len(words) - index.passage), index.passage):
        own = numbers[at : at + 2 * index.passage]
        terms = np.unique(own[own >= 0])
        if not possible(index, terms):
            continue
        passage = words[at : at + 2 * index.passage]
        for item, score in block_max_wand(index, terms):
            width, grams, half = index.shingles[item]
            if len(passage) < width:
                continue
            inside = np.isin(grams, chained(passage, width))
            shares = inside.mean(), inside[:half].mean(), inside[half:].mean() if half < len(grams) else inside.mean()
            if shares[0] >= OVERLAP - 1e-9 and min(shares[1:]) >= PART_OVERLAP and shares[0] > best.get(item, (0, 0, 0))[2]:
                best[item] = (item, score, *(float(s) for s in shares))
    return sorted(best.values())


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_items: int = SHARD_ITEMS) -> list[Index]:
    """Indexes of about ``shard_items`` items each, so that what one job ships stays bounded."""
    items = benchmark.select(quoted(item_id).alias("id"), quoted(text).alias("text"))
    shards = max(1, -(-items.count() // shard_items))
    built = []
    for k in range(shards):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).orderBy("id", "text").collect()
        built.append(build_index([r[0] for r in rows], [r[1] for r in rows]))
    return [b for b in built if b is not None]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): one row per document row and item found in it.

    Words are lower-cased, ASCII punctuation is left out. Items of fewer than five words
    are one shingle; items without a word, and null or empty texts, match nothing.
    Repeated rows are reported as often as they occur; other columns are ignored.
    """
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    item_type = benchmark.select(quoted(item_id)).schema.fields[0].dataType
    names = ["score", "overlap", "question_overlap", "answer_overlap"]
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), StructField("item_id", item_type), *[StructField(n, DoubleType()) for n in names]])
    arrow_item = to_arrow_schema(schema).field(1).type
    out = source.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, item_id, item_text):

        def run(batches, index=index):
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in matches(index, t)]
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([index.ids[k] for k in columns[1]], type=arrow_item),
                        *[pa.array(c, type=pa.float64()) for c in columns[2:]],
                    ],
                    schema.fieldNames(),
                )

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in which no item is found, columns unchanged."""
    for index in indexes(benchmark, item_id, item_text):
        docs = keep_texts(docs, text, lambda texts, index=index: [not matches(index, t) for t in texts])
    return docs
