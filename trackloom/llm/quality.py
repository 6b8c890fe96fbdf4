"""Quality classifier: a generalised additive model with pairwise interactions over surface features of whole texts.

Each feature has a lookup table over quantile bins, learned by cyclic boosting: round after round, each feature in turn gets
a shallow tree (at most three cuts) fitted to the gradient of the log loss and added with a small rate. Then the pairs whose
two-way tables explain most of what is left are boosted the same way on coarser bins. A score is the sigmoid of the
intercept and one table entry for each feature and pair, so scoring is binning and additions on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import Block, blocks
from .tables import free_name, hashed_sample, map_arrow

#: The model is fitted on at most so many labelled rows, those of the smallest hashes of their ids.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "upper", "digits", "marks", "marks_in_words", "bars", "line_words", "repeated_lines",
    "sentence_words", "capital_words", "spaces", "accented", "top_word", "short_words", "control",
)


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, ALPHA = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = DIGIT[48:58] = ALPHA[65:91] = ALPHA[97:123] = ALPHA[128:] = True
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK &= ~(ALPHA | DIGIT)
ODD, END = MARK & ~table_of(".,;:'\"?-()"), table_of(".?")
SPACE, CONTROL = table_of(" \t\n\r\v\f"), np.zeros(256, bool)
CONTROL[:32] = True
CONTROL &= ~SPACE


def measure(block: Block) -> np.ndarray:
    """One row of FEATURES for each document of a block of unchanged bytes; every value of an empty text is 0."""
    raw, at = block.data, block.offsets
    n = np.diff(at).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    lowered = Block(block.first, block.last, raw, at).find_words()
    space = SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    first[at[:-1][at[:-1] < len(raw)]] = ~space[at[:-1][at[:-1] < len(raw)]]
    tokens = np.maximum(count(first), 1)
    size, chars = np.maximum(n, 1), np.maximum(count((raw & 0xC0) != 0x80), 1)
    newline = raw == 10
    lines = count(newline) + 1
    odd = ODD[raw]
    inner = odd.copy()
    inner[1:] &= ALPHA[raw[:-1]] | odd[:-1]
    words = np.diff(lowered.word_at).astype(np.float64)
    lengths = (lowered.ends - lowered.starts).astype(np.float64)

    def by_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[lowered.word_at[1:]] - total[lowered.word_at[:-1]]

    lowered.hash_words()
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    repeated = np.zeros(len(n))
    for d in range(len(n)):
        own = lowered.words[lowered.word_at[d] : lowered.word_at[d + 1]]
        if len(own):
            ordered = np.sort(own)
            cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            distinct[d], top[d] = (len(cuts) - 1) / len(own), np.diff(cuts).max() / len(own)
        if lines[d] > 1:
            parts = raw[at[d] : at[d + 1]].tobytes().split(b"\n")
            repeated[d] = 1 - len(set(parts)) / len(parts)
    total = np.maximum(words, 1)
    columns = [
        np.log1p(words), by_word(lengths) / total, by_word(lengths > 14) / total, distinct, count(UPPER[raw]) / size, count(DIGIT[raw]) / size,
        count(odd) / size, count(inner) / tokens, count(raw == 124) / tokens, np.minimum(tokens / lines, 1000), repeated,
        np.minimum(tokens / (count(END[raw]) + 1), 1000), by_word(UPPER[raw[lowered.starts]]) / total, count(space) / size, count(raw >= 0xC3) / chars, top,
        by_word(lengths <= 3) / total, count(CONTROL[raw]) / size,
    ]
    out = np.stack(columns, axis=1)
    out[n == 0] = 0
    return out


@dataclass
class Model:
    """intercept, cuts[f] (ascending bin borders), tables[f], and pairs of (f, g, coarse cuts of f, of g, table)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for f, g, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def borders(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, cuts: int, floor: float = 1.0) -> np.ndarray:
    """Values by bin of the tree that splits the bins greedily at most ``cuts`` times; Newton steps in the leaves."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    leaves = [(0, len(gradient))]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + floor)
    for _ in range(cuts):
        best, where = 1e-9, None
        for k, (a, b) in enumerate(leaves):
            for c in range(a + 1, b):
                if (got := gain(a, c) + gain(c, b) - gain(a, b)) > best:
                    best, where = got, (k, c)
        if where is None:
            break
        a, b = leaves.pop(where[0])
        leaves += [(a, where[1]), (where[1], b)]
    out = np.zeros(len(gradient))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + floor)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 24, coarse: int = 6, rounds: int = 120, rate: float = 0.15, cuts: int = 3, pairs: int = 6, pair_rounds: int = 40) -> Model:
    """The model for labels y (0 or 1). Without both labels it is a constant: the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [borders(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    places = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, place in enumerate(places):
            if not len(model.cuts[f]):
                continue
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(place, g, size), np.bincount(place, h, size), cuts)
            model.tables[f] += step
            total += step[place]
    small = [borders(x[:, f], coarse) for f in range(x.shape[1])]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(small)]
    g, h = slopes()
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            cell, size = rough[a] * coarse + rough[b], coarse * coarse
            ranked.append(((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 1)).sum(), a, b))
    chosen = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:pairs]]
    grids = {ab: np.zeros((coarse, coarse)) for ab in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            g, h = slopes()
            cell, size = rough[a] * coarse + rough[b], coarse * coarse
            sums = np.bincount(cell, g, size).reshape(coarse, coarse), np.bincount(cell, h, size).reshape(coarse, coarse)
            best, step = -1.0, np.zeros((coarse, coarse))
            for c in range(1, coarse):  # a cut of one feature, then a cut of the other on each side
                found = np.zeros((coarse, coarse))
                for part in (slice(0, c), slice(c, coarse)):
                    found[part] = shallow_tree(sums[0][part].sum(axis=0), sums[1][part].sum(axis=0), 1)
                if (got := (found * sums[0]).sum()) > best:
                    best, step = got, found
            grids[a, b] += rate * step
            total += rate * step[rough[a], rough[b]]
    model.pairs = [(a, b, small[a], small[b], grids[a, b]) for a, b in chosen]
    return model


def features(keys: list[str]) -> Callable:
    """mapInArrow: (*keys, text) -> (*keys, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(len(keys)), lower=False):
                x = measure(block)
                n = len(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(block.first, n) for k in range(len(keys))), lists], [*keys, "x"])

    return run


def scores(model: Model, text_at: int, names: list[str]) -> Callable:
    """mapInArrow: appends the score, under the last of the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_at), lower=False):
                score = model.score(measure(block))
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, len(score)) for c in batch.columns), pa.array(score)], names)

    return run


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` labelled documents that aren't held out.

    Ids with a null label, several labels, or no document don't count; of a repeated id one text counts, that of the least features.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    known = known.join(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id")).distinct(), "id", "left_semi")
    picked = hashed_sample(known.select("id", "y"), "id", sample, seed=6)
    if picked.isEmpty():
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    picked = F.broadcast(picked)  # at most ``sample`` rows
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    measured = map_arrow(texts.join(picked, "id").select("id", "y", "text"), features(["id", "y"]), "id bigint, y int, x array<double>")
    told = sorted((r.id, r.y, tuple(r.x)) for r in measured.groupBy("id", "y").agg(F.min("x").alias("x")).collect())  # one row for each id
    return fit(np.array([t[2] for t in told]), np.array([t[1] for t in told], dtype=np.float64))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's rows and columns, and ``score_col``: the probability that a document is good.

    Null texts are empty; empty texts get the score of an empty text; no other column takes part in a score. If the input has a column of
    that name, its own stays and the score is called by the name with underscores before it, as ``free_name`` tells.
    """
    if score_col.lower() in (c.lower() for c in docs.columns):
        score_col = free_name(docs, score_col)
    texts = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([*texts.schema.fields, T.StructField(score_col, T.DoubleType())])
    return map_arrow(texts, scores(model, texts.columns.index(text_col), schema.names), schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of a score of at least ``least``, with their own columns, whatever these are called."""
    name = free_name(docs, "score")
    return score_quality(docs, model, text_col, name).where(F.col(name) >= least).drop(name)
