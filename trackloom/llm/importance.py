"""Importance resampling to a target distribution by hashed n-grams.

Features of a text are its runs of 1 to ``ngram`` consecutive words (see ``bytetext``), joined by one blank, repeats counted; a feature's bucket is the CRC-32
of its bytes modulo ``buckets``. A bucket's gain is 1000 times the logarithm of the target's share over the corpus's share of features in it, each bucket
counted once more. A document's weight is the sum of its features' gains; its score adds Gumbel noise from a hash of its id, so the highest scores are a
draw without replacement with odds that follow the weights. Counts, gains and scores cover all documents; nothing is cut.

Within a task, the features of some megabytes of texts are interned in an open-addressed table of numpy arrays: keys are xxhash64 values, a slot
is another feature's unless its bytes are equal, and each filled slot stores its feature's bucket and count. Occurrences keep their slots' numbers:
counting sums the counts by bucket, and weighing gathers the slots' gains by them.

The counts of ``buckets`` buckets are all that reaches the driver, and their gains all that is sent to tasks. The order of the scores is found by
``tables.ranked``, over rows of an id and a few numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import Block, U, blocks
from .tables import free_name, map_arrow, ranked, written

NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of whole texts that share a table.
TABLE_BYTES = 2 << 20
#: Fixed values of the 64-bit xxhash.
PRIME_1, PRIME_2, PRIME_3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
PRIME_4, PRIME_5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as one number; data must end with eight bytes more than are asked for."""
    return np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def hash_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 with seed 0 of many pieces of data at once; pieces of 32 bytes and more, which have another form, one by one."""
    wide = eights(data)
    keys = PRIME_5 + sizes.astype(U)
    at, left = starts.copy(), sizes.copy()
    short = sizes < 32
    while len(on := np.flatnonzero(short & (left >= 8))):
        lane = turned(wide[at[on]] * PRIME_2, 31) * PRIME_1
        keys[on] = turned(keys[on] ^ lane, 27) * PRIME_1 + PRIME_4
        at[on] += 8
        left[on] -= 8
    if len(on := np.flatnonzero(short & (left >= 4))):
        lane = (wide[at[on]] & U(0xFFFFFFFF)) * PRIME_1
        keys[on] = turned(keys[on] ^ lane, 23) * PRIME_2 + PRIME_3
        at[on] += 4
        left[on] -= 4
    while len(on := np.flatnonzero(short & (left > 0))):
        keys[on] = turned(keys[on] ^ (data[at[on]].astype(U) * PRIME_5), 11) * PRIME_1
        at[on] += 1
        left[on] -= 1
    keys = (keys ^ (keys >> U(33))) * PRIME_2
    keys = (keys ^ (keys >> U(29))) * PRIME_3
    keys = keys ^ (keys >> U(32))
    raw = data.data
    for k in np.flatnonzero(~short).tolist():
        keys[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return keys


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the pieces of equal sizes from a and from b on are the same bytes."""
    wide, same, done = eights(data), np.ones(len(a), dtype=bool), 0
    on = np.arange(len(a))
    while len(on := on[same[on] & (sizes[on] > done)]):
        drop = U(8) * (U(8) - np.minimum(sizes[on] - done, 8).astype(U))  # bits beyond the end
        same[on] = (wide[a[on] + done] << drop) == (wide[b[on] + done] << drop)
        done += 8
    return same


class Interned:
    """The features of some texts in an open-addressed table.

    slot: each occurrence's slot; owner: the occurrence whose bytes fill a slot, or -1; bucket and count of each slot; filled: the slots in use.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        keys = hash_keys(data, starts, sizes) if keys is None else keys
        room = 1 << max(4, (2 * len(keys)).bit_length())
        self.owner = np.full(room, -1, dtype=np.int64)
        self.slot = (keys & U(room - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that want a slot, one has it
            of = self.owner[at]
            alike = (keys[of] == keys[left]) & (sizes[of] == sizes[left])
            alike[alike] = equal_bytes(data, starts[of[alike]], starts[left[alike]], sizes[left[alike]])
            left = left[~alike]
            self.slot[left] = (self.slot[left] + 1) & (room - 1)
        self.filled = filled = np.flatnonzero(self.owner >= 0)
        self.bucket, self.count = np.zeros(room, dtype=np.int64), np.bincount(self.slot, minlength=room)
        raw = data.data
        first, last = starts[self.owner[filled]].tolist(), (starts + sizes)[self.owner[filled]].tolist()
        self.bucket[filled] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(first, last, strict=True)]


def features(block: Block, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words with one blank after each; starts, sizes and documents of all runs of 1 to ngram words."""
    block.find_words()
    sizes = block.ends - block.starts
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    joined = np.full(total + len(sizes) + 8, 32, dtype=np.uint8)
    within = np.arange(total) - np.repeat(begin, sizes)
    joined[within + np.repeat(begin + np.arange(len(sizes)), sizes)] = block.data[within + np.repeat(block.starts, sizes)]
    starts = begin + np.arange(len(sizes))
    ends, owner = starts + sizes, np.repeat(np.arange(len(block.word_at) - 1), np.diff(block.word_at))
    found = []
    for n in range(1, ngram + 1):
        last = np.arange(n - 1, len(starts))
        first = last - (n - 1)
        own = owner[first] == owner[last]
        first, last = first[own], last[own]
        found.append((starts[first], ends[last] - starts[first], owner[first]))
    return (joined, *(np.concatenate(x) for x in zip(*found, strict=True)))


def count_buckets(ngram: int, buckets: int):
    """mapInArrow: (text) -> (bucket, n), once for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), TABLE_BYTES):
                data, starts, sizes, _ = features(block, ngram)
                table = Interned(data, starts, sizes, buckets)
                np.add.at(total, table.bucket[table.filled], table.count[table.filled])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def weigh_texts(gains: list[int], ngram: int, names: list[str]):
    """mapInArrow: (text, further columns) -> (further columns, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), TABLE_BYTES):
                data, starts, sizes, owner = features(block, ngram)
                table = Interned(data, starts, sizes, len(gain))
                n = block.last - block.first
                weight = np.zeros(n, dtype=np.int64)
                np.add.at(weight, owner, gain[table.bucket][table.slot])
                kept = [batch.column(k).slice(block.first, n) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(block.word_at)), pa.array(np.bincount(owner, minlength=n)), pa.array(weight)], names)

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts of a table; buckets without features are left out."""
    counted = map_arrow(df.select(F.col(f"`{text_col}`").cast("string").alias("text")), count_buckets(ngram, buckets), "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from two tables of bucket counts: the one thing that passes through the driver, ``buckets`` numbers."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    counts = {r.bucket: (r.s, r.t) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = float(sum(s for s, _ in counts.values()) + buckets), float(sum(t for _, t in counts.values()) + buckets)
    made = []
    for k in range(buckets):
        s, t = counts.get(k, (0, 0))
        made.append(math.floor(1000 * math.log(float(t + 1) * all_s / (float(s + 1) * all_t))))
    return made


def noise(key: Column, seed: int) -> Column:
    """1000 times a standard Gumbel variate from a hash of the key, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def weighed(docs: DataFrame, gains: list[int], keep: dict[str, Column], text_col: str, ngram: int) -> DataFrame:
    """The columns of ``keep``, n_words, n_features and weight of each row."""
    held = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[c.alias(n) for n, c in keep.items()])
    facts = ["n_words", "n_features", "weight"]
    schema = T.StructType([*held.schema.fields[1:], *[T.StructField(n, T.LongType()) for n in facts]])
    return map_arrow(held, weigh_texts(gains, ngram, schema.names), schema)


def fit_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", *, ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """The gains by bucket that lead from the distribution of one table's texts to that of another's."""
    return gains_of(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_text_col, ngram, buckets), buckets)


def draw_scores(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    *,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank.

    Of the N rows of at least ``least_words`` words, the floor(percent * N / 100) of the highest scores have ranks 1, 2, 3, ...; ties go to the smaller id, null
    ids after all others, then to any of the repeated rows. Null texts are empty: no features, weight 0, no rank. Null ids share one number as noise. Further columns are
    ignored; an empty table gives an empty result; with an empty target the gains only thin out what is frequent.
    """
    gains = fit_gains(docs, target, text_col, target_text_col, ngram=ngram, buckets=buckets)
    rows = weighed(docs, gains, {"id": F.col(f"`{id_col}`")}, text_col, ngram)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    total = rows.where(able).count()
    placed = ranked(rows, [(~able).asc(), F.col("score").desc(), F.col("id").asc_nulls_last()])
    return placed.withColumn("rank", F.when(able & (F.col("place") < percent * total // 100), F.col("place") + 1)).drop("place")


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    *,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows themselves, with all their own columns only.

    The last drawn place is looked up in the order of the scores, and rows are kept where they are, without a join: rows of equal id and text stay or go together.
    """
    gains = fit_gains(docs, target, text_col, target_text_col, ngram=ngram, buckets=buckets)
    row, key = free_name(docs, "row"), free_name(docs, "key")
    carried = {row: F.struct(*[F.col(f"`{c}`") for c in docs.columns]), key: F.col(f"`{id_col}`")}
    rows = weighed(docs, gains, carried, text_col, ngram).where(F.col("n_words") >= least_words).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    order = F.struct(F.col("score"), F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    placed = ranked(rows.select("score", F.col(key).alias("key")), [F.col("score").desc(), F.col("key").asc_nulls_last()])
    placed = written(placed, "order")
    last = placed.where(F.col("place") == percent * placed.count() // 100 - 1).select(F.struct("score", F.col("key").isNull().alias("none"), "key").alias("last")).first()
    if last is None:
        return docs.limit(0)
    score, none, at = last["last"]
    within = (order["score"] > score) | ((order["score"] == score) & (F.lit(none) | (~order["none"] & (order["key"] <= F.lit(at)))))
    return rows.where(within).select(f"{row}.*")


#: The same draw in DuckDB. CRC-32 by its table of 256 entries, made by the rule of the polynomial, once for each distinct word.
DRAW_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT kind, id, word, count(*) AS n FROM words GROUP BY ALL
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[1 + CAST(xor(c, b) & 255 AS INT)], c // 256)), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)), crc
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, totals
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""
