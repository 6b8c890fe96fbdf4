"""Benchmark decontamination: exact weighted-shingle similarity of item-sized windows, found by an index of rare shingles.

For each benchmark item of n words, windows of n words of a document are compared with it. A window's similarity is the weight of the
shingles that it and the item share, with multiplicity, over the weight of the item's shingles. A shingle weighs
log(1 + items / items with it), counted over the whole benchmark, so boilerplate of many items counts less.

1. Of each item the rarest shingles that together weigh more than 1 - ``threshold`` of it are indexed. A window that has none of them
   is below the threshold, so looking up a document's shingles finds every item that it may hold.
2. The similarity of all windows with each such item is computed at once: an occurrence of a shingle counts for the windows in which
   fewer than the item's number of occurrences precede it, so it adds its weight to one range of window starts.
3. Of equally similar windows the nearest by SimHash wins: the sign of the summed word votes (64 bits) of window and item, and
   ``distance`` is the number of different bits. SimHash decides nothing else: no distance bound is implied by a similarity.

Texts are read whole. Items are broadcast in portions of about ``PORTION_WORDS`` words, each with the weights of its own shingles; a
larger benchmark takes more passes over the documents. All texts of an item id are in one portion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, Block, blocks, mix
from .tables import map_arrow, written

NGRAM, THRESHOLD, PORTION_WORDS = 5, 0.8, 1_000_000
SCHEMA = "id bigint, item bigint, start bigint, words bigint, distance bigint, similarity double"


def votes(words: np.ndarray) -> np.ndarray:
    """One row of 64 votes, 1 or -1, for each word hash."""
    bits = np.unpackbits(mix(words ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int16) * 2 - 1


def fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at the given places."""
    total = np.zeros((len(words) + 1, 64), dtype=np.int32)
    np.cumsum(votes(words), axis=0, out=total[1:])
    return np.packbits(total[starts + size] - total[starts] > 0, axis=1).reshape(-1, 8).copy().view(U).reshape(-1)


@dataclass
class Item:
    item: int
    words: int
    fingerprint: U
    shingles: np.ndarray  # ascending
    counts: np.ndarray  # of each shingle
    weights: np.ndarray  # of each shingle once
    weight: float


class Index:
    """Items, and their rare shingles with the item of each."""

    def __init__(self, items: list[tuple[int, str]], ngram: int, threshold: float, weights: tuple[np.ndarray, np.ndarray]):
        self.ngram, self.items = ngram, []
        rare, owner = [], []
        known, value = weights
        for key, text in items:
            block = words_of(text, ngram)
            n = len(block.words)
            if not n:
                continue
            shingles, counts = np.unique(block.shingles, return_counts=True)
            each = value[np.searchsorted(known, shingles)]
            weight = float((each * counts).sum())
            order = np.argsort(-each, kind="stable")
            sums = np.cumsum((each * counts)[order])
            taken = int(np.searchsorted(sums, (1 - threshold) * weight + 1e-9 * weight, side="right")) + 1
            rare.append(shingles[order[:taken]])
            owner.append(np.full(len(rare[-1]), len(self.items)))
            self.items.append(Item(key, n, fingerprints(block.words, np.zeros(1, dtype=np.int64), n)[0], shingles, counts, each, weight))
        shingle = np.concatenate(rare) if rare else np.zeros(0, dtype=U)
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.owner = shingle[order], (np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64))[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.shingle >> U(42)).astype(np.int64)] = True


def words_of(text: str, ngram: int) -> Block:
    return next(blocks(pa.array([text or ""]), size=1 << 62)).find_words().hash_words().hash_shingles(ngram)


def similarities(order: np.ndarray, values: np.ndarray, span: int, starts: int, item: Item) -> np.ndarray:
    """Of each window of ``span`` shingles, the shared weight over the item's.

    values: the document's shingles, ascending; order: their places.
    """
    low, high = np.searchsorted(values, item.shingles, side="left"), np.searchsorted(values, item.shingles, side="right")
    shared = np.zeros(starts + 1)
    for k in np.flatnonzero(high > low).tolist():
        places, count = order[low[k] : high[k]], int(item.counts[k])
        first = np.maximum(0, places - span + 1)
        if len(places) > count:  # a window that holds as many earlier occurrences has its share of this shingle
            first[count:] = np.maximum(first[count:], places[:-count] + 1)
        last = np.minimum(places, starts - 1)
        on = first <= last
        np.add.at(shared, first[on], item.weights[k])
        np.subtract.at(shared, last[on] + 1, item.weights[k])
    return np.cumsum(shared[:-1]) / item.weight


def similarity(window: np.ndarray, item: Item) -> float:
    """Shared weight over the item's weight; window: the shingles in it."""
    values, counts = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(values, item.shingles), len(values) - 1)
    shared = np.where(values[at] == item.shingles, np.minimum(counts[at], item.counts), 0)
    return float((shared * item.weights).sum() / item.weight)


def matches(block: Block, d: int, hits: np.ndarray, index: Index, threshold: float) -> dict[int, tuple[int, int, int, float]]:
    """Of one document, the best window of each item: item -> (start, words, distance, similarity).

    hits: places of the document's shingles that are indexed. The nearest of equally similar windows wins, then the first.
    """
    words = block.words[block.word_at[d] : block.word_at[d + 1]]
    own = block.shingles[block.shingle_at[d] : block.shingle_at[d + 1]]
    found = np.unique(own[hits])
    low, high = np.searchsorted(index.shingle, found, side="left"), np.searchsorted(index.shingle, found, side="right")
    order = np.argsort(own, kind="stable")
    values = own[order]
    best: dict[int, tuple[int, int, int, float]] = {}
    for k in np.unique(np.concatenate([index.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])).tolist():
        item = index.items[k]
        size = min(item.words, len(words))  # a shorter document is one window
        span = max(1, size - index.ngram + 1)
        got = similarities(order, values, span, max(1, len(words) - size + 1), item)
        top = float(got.max())
        if top < threshold - 1e-9:
            continue
        starts = np.flatnonzero(got >= top - 1e-9)
        nearest: tuple[int, int] | None = None
        for chunk in np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1):
            prints = fingerprints(words[chunk[0] : chunk[-1] + size], chunk - chunk[0], size)
            distance = np.bitwise_count(prints ^ item.fingerprint)
            at = int(np.argmin(distance))
            if nearest is None or int(distance[at]) < nearest[0]:
                nearest = int(distance[at]), int(chunk[at])
        distance, start = nearest
        exact = similarity(own[start : start + span], item)
        old = best.get(item.item)
        if exact >= threshold - 1e-12 and (old is None or (-exact, distance, start) < (-old[3], old[2], old[0])):
            best[item.item] = (start, size, distance, exact)
    return best


def found_in(column: pa.Array, index: Index, threshold: float) -> Iterator[tuple[int, dict[int, tuple[int, int, int, float]]]]:
    """(row, item -> facts) of each text of a column in which an item was found."""
    for block in blocks(column):
        block.find_words().hash_words().hash_shingles(index.ngram)
        likely = np.flatnonzero(index.bits[(block.shingles >> U(42)).astype(np.int64)])
        likely = likely[np.isin(block.shingles[likely], index.shingle)]
        docs = np.searchsorted(block.shingle_at, likely, side="right") - 1
        for d in np.unique(docs).tolist():
            found = matches(block, d, likely[docs == d] - block.shingle_at[d], index, threshold)
            if found:
                yield block.first + d, found


def scan(index_of: Callable[[], Index], threshold: float) -> Callable:
    """mapInArrow: (id, text) -> SCHEMA, a row for each document and item found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            out: list[tuple] = []
            for row, found in found_in(batch.column(1), index, threshold):
                key = batch.column(0)[row].as_py()
                out += [(key, item, *facts) for item, facts in sorted(found.items())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item", "start", "words", "distance", "similarity"])

    return run


def clean(index_of: Callable[[], Index], threshold: float, text_at: int) -> Callable:
    """mapInArrow: the rows in whose text no item was found, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            for row, _ in found_in(batch.column(text_at), index, threshold):
                stay[row] = False
            yield batch.filter(pa.array(stay))

    return run


def read_items(ngram: int) -> Callable:
    """mapInArrow: (item, text) -> (item, text, words, shingles), the different shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                block.find_words().hash_words().hash_shingles(ngram)
                sets = [np.unique(block.shingles[a:b]).view(np.int64) for a, b in zip(block.shingle_at[:-1], block.shingle_at[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64()))
                n = block.last - block.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n), pa.array(np.diff(block.word_at), pa.int64()), lists],
                    ["item", "text", "words", "shingles"],
                )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    portion_words: int = PORTION_WORDS,
) -> DataFrame:
    """(id, item, start, words, distance, similarity): the best window of each item in each document that holds it.

    Places count words from 0. Null texts are empty and items without words match nothing; items and documents of fewer than
    ``ngram`` words have one shingle; repeated rows are each reported; items of one id and several texts report the best; null item ids
    are left out; further columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = [map_arrow(texts, scan(index, threshold), SCHEMA) for index in indexes(benchmark, item_col, item_text_col, ngram, threshold, portion_words)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str, ngram: int, threshold: float, portion_words: int) -> list[Callable[[], Index]]:
    """What makes the index of each portion of the benchmark in a task, with the shingle weights of the whole benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    items = map_arrow(items.where("item is not null and text is not null").distinct(), read_items(ngram), "item bigint, text string, words bigint, shingles array<bigint>")
    items = written(items, "items")
    total, words = items.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not words:
        return []
    n = -(-words // portion_words)
    items = items.withColumn("portion", F.pmod(F.xxhash64("item"), F.lit(n)))
    counts = items.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    used = written(items.select("portion", F.explode("shingles").alias("shingle")).distinct().join(counts, "shingle"), "item_shingles")
    found = []
    for k in range(n):
        own = items.where(F.col("portion") == k).orderBy("item", "text").select("item", "text").collect()
        facts = used.where(F.col("portion") == k).select("shingle", "n").toArrow()
        shingle, seen = facts["shingle"].to_numpy().view(U), facts["n"].to_numpy()
        order = np.argsort(shingle)
        held = spark.sparkContext.broadcast(([(r.item, r.text) for r in own], (shingle[order], np.log1p(total / seen[order]))))
        found.append(index_from(held, ngram, threshold))
    return found


def index_from(held, ngram: int, threshold: float) -> Callable[[], Index]:
    def make() -> Index:
        items, weights = held.value
        return Index(items, ngram, threshold, weights)

    return make


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    portion_words: int = PORTION_WORDS,
) -> DataFrame:
    """The rows in whose text no item was found, with all their columns.

    Each row is judged by its own text where it is, so nothing is shuffled: rows of a repeated or null id stay or go one by one. Null texts
    stay; an empty benchmark keeps all; an empty table stays empty.
    """
    for index in indexes(benchmark, item_col, item_text_col, ngram, threshold, portion_words):
        docs = map_arrow(docs, clean(index, threshold, docs.columns.index(text_col)), docs.schema)
    return docs
