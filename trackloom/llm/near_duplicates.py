"""N-gram Jaccard join: MinHash buckets, Bayesian pruning of candidate pairs, exact verification.

Texts are word sequences (see ``bytetext``); a document's set is that of its shingles of ``ngram`` words, or one shingle of
all words where it has fewer. Documents of equal word sequences are copies: they count as one node, told by a 128-bit
digest of the sequence, and are never expanded into pairs. Texts without any word are copies only of equal texts.

1. ``sign``: MinHash values of each document, packed so that a band of four values is one long.
2. Nodes that agree in a band meet in a bucket. Within a bucket, pairs compare their MinHash values a few at a time; a pair is
   dropped as soon as the posterior probability that its similarity reaches the threshold, after m of n agreements and a uniform
   prior, is below ``tolerance``. A task handles at most two blocks of ``block`` nodes: larger buckets are dealt out as pairs of
   blocks, so no bucket is capped. What survives leaves as a spanning forest, not as pairs.
3. Components of the survivors are verified exactly: the shingle sets of whole texts are written once, and dealt out in pairs of blocks; the
   intersections of all sets of two blocks are one product of incidence matrices. A component is cut into no more blocks than keep a task's share of
   all pairs, so the sets of small ones go to one task each, however many partitions there are. Links leave as counts for each
   document and a spanning forest, so a group of n near copies yields rows in proportion to n.

With 20 bands of 4 a pair of similarity exactly 0.8 meets in a bucket with probability 1 - 2.6e-5, at 0.9 with 1 - 8e-10; pairs in
one component are all verified whether or not they met.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import U, Block, blocks, mix
from .components import connected_components
from .tables import free_name, map_arrow, written

NGRAM, THRESHOLD, BANDS, ROWS, TOLERANCE = 5, 0.8, 20, 4, 1e-6
BLOCK, VERIFY_BLOCK, VERIFY_LEAST, STEP = 8192, 512, 64, 16
#: In a verify block so many shingles count as a row, so blocks of long texts have fewer of them.
ROW_SHINGLES = 640
#: Up to so many rows of six longs are broadcast to pick the texts to verify; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 64, count, dtype=U), rng.integers(0, 1 << 63, count, dtype=U) * U(2) + U(1)


def minhashes(block: Block, bands: int, rows: int) -> np.ndarray:
    """16 bits of each of bands*rows MinHash values by document; documents without shingles have random ones, alike nowhere."""
    count = bands * rows
    xor, times = seeds(count)
    per = np.diff(block.shingle_at)
    full = np.flatnonzero(per)
    out = np.zeros((len(per), count), dtype=np.uint16)
    at = block.shingle_at[:-1][full]
    if len(full):
        for k in range(count):
            low = np.minimum.reduceat((block.shingles ^ xor[k]) * times[k], at)
            out[full, k] = (mix(low) >> U(48)).astype(np.uint16)
    for d in np.flatnonzero(per == 0):
        out[d] = np.frombuffer(np.random.default_rng(int(block.nodes[d]) & ((1 << 63) - 1)).bytes(2 * count), dtype=np.uint16)
    return out


def sign(ngram: int, bands: int, rows: int):
    """mapInArrow: (id, text, print) -> (id, print, node, check, signature); node and check are the digest's two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                block.find_words().hash_words().hash_shingles(ngram)
                found = block.digests()
                block.nodes, checks = found[:, 0].copy(), found[:, 1].copy()
                packed = np.ascontiguousarray(minhashes(block, bands, rows)).view(np.int64)
                n = block.last - block.first
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), batch.column(2).slice(block.first, n), pa.array(block.nodes), pa.array(checks), lists],
                    ["id", "print", "node", "check", "signature"],
                )

    return run


def least_agreements(values: int, threshold: float, tolerance: float, step: int) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m agreements is dropped.

    The posterior of the similarity after m of n agreements is Beta(m+1, n-m+1); its mass above the threshold equals
    the chance that a Binomial(n+1, threshold) is at most m.
    """
    from math import comb

    plan = []
    for n in [*range(step, values, step), values]:
        mass = 0.0
        for m in range(n + 1):
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
        plan.append((n, m))
    return plan


class Forest:
    """Labels of a block's rows; rows that meet share the smallest row as label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, row: int, others: np.ndarray) -> None:
        found = np.unique(self.label[np.append(others, row)])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]


def survivors(left: np.ndarray, right: np.ndarray, band: int, rows: int, plan: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of left, the rows of right that first meet it in this band and outlive the incremental comparison."""
    wide_left, wide_right = left.view(np.uint16).reshape(len(left), -1), right.view(np.uint16).reshape(len(right), -1)
    step = max(1, 250_000 // max(1, len(right)))
    for low in range(0, len(left), step):
        part, wide = left[low : low + step], wide_left[low : low + step]
        i, j = np.divmod(np.arange(len(part) * len(right)), len(right))
        for b in range(band):  # pairs that met in an earlier bucket were compared there
            new = part[i, b] != right[j, b]
            i, j = i[new], j[new]
        agreed, done = np.zeros(len(i), dtype=np.int16), 0
        for n, least in plan:
            agreed = agreed + (wide[i, done:n] == wide_right[j, done:n]).sum(axis=1, dtype=np.int16)
            on = agreed >= least
            i, j, agreed, done = i[on], j[on], agreed[on], n
            if not len(i):
                break
        order = np.flatnonzero(np.diff(i, prepend=-1))
        for k, at in enumerate(order):
            yield low + int(i[at]), j[at : order[k + 1] if k + 1 < len(order) else None]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal leading columns of sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[low].item() for c in cols)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        yield current, pa.Table.from_batches(held)


def prune(bands: int, rows: int, plan: list[tuple[int, int]]):
    """mapInArrow over rows sorted by (bucket, i, j): (bucket, i, j, band, side, node, signature) -> (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        held = 0
        for (_, i, j), rows_of in grouped(batches, 3):
            if rows_of.num_rows < 2:
                continue
            side = rows_of["side"].to_numpy()
            nodes = rows_of["node"].to_numpy()
            signs = rows_of["signature"].combine_chunks()
            signs = (signs.chunk(0) if isinstance(signs, pa.ChunkedArray) else signs).flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), bands)
            band = rows_of["band"][0].as_py()
            order = np.argsort(side, kind="stable")
            nodes, signs, cut = nodes[order], np.ascontiguousarray(signs[order]), int((side == 0).sum())
            left, right, shift = (slice(0, cut), slice(cut, None), cut) if i != j else (slice(None), slice(None), 0)
            forest = Forest(len(nodes))
            for row, others in survivors(signs[left], np.ascontiguousarray(signs[right]), band, rows, plan):
                others = others + shift
                if (others := others[others > row]).size:
                    forest.join(row, others)
            moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
            if len(moved):
                us.append(nodes[moved])
                vs.append(nodes[forest.label[moved]])
                held += len(moved)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def hash_sets(ngram: int):
    """mapInArrow: (node, check, copies, root, text) -> (node, copies, root, shingles): sorted distinct shingles; rows whose text has another digest are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(4)):
                block.find_words().hash_words().hash_shingles(ngram)
                part = batch.slice(block.first, block.last - block.first)
                own = np.flatnonzero(block.digests()[:, 1] == part.column(1).to_numpy())
                sets = [np.unique(block.shingles[block.shingle_at[k] : block.shingle_at[k + 1]]) for k in own]
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in sets)]), pa.int32()), pa.array(values))
                kept = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), kept.column(3), lists], ["node", "copies", "root", "shingles"])

    return run


def intersections(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly: shingles of one set only are left out, the rest multiply in slices of columns."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(values)))
    column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)
    owner, column = owner[column >= 0], column[column >= 0]
    total = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, min(width, total - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = sizes
    return out


def alike(sets: list[np.ndarray], threshold: float, step: int = 256) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold; empty sets are like nothing."""
    common, sizes = intersections(sets), np.array([len(s) for s in sets], dtype=np.float64)
    out = np.zeros(common.shape, dtype=bool)
    for low in range(0, len(sizes), step):
        part = common[low : low + step].astype(np.float64)
        union = sizes[low : low + step, None] + sizes[None, :] - part
        out[low : low + step] = (part >= threshold * union - 1e-9) & (union > 0)
    return out


def verify(threshold: float):
    """mapInArrow over rows sorted by (root, i, j): (root, i, j, side, node, copies, shingles) -> (node, other, links, text_links).

    other is null in rows that carry counts; rows of the spanning forest have zero counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in grouped(batches, 3):
            if rows.num_rows < 2:
                continue
            nodes, side, copies = rows["node"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy()
            sets = [np.asarray(x.values).view(U) for x in rows["shingles"]]
            linked = alike(sets, threshold)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= side[:, None] != side[None, :]
            forest = Forest(len(nodes))
            for row in np.flatnonzero(linked.any(axis=1)):
                forest.join(int(row), np.flatnonzero(linked[row]))
            moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
            counted = np.flatnonzero(linked.any(axis=1))
            zero = np.zeros(len(moved), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nodes[counted], nodes[moved]])),
                    pa.array(np.concatenate([nodes[counted], nodes[forest.label[moved]]]), mask=np.concatenate([np.ones(len(counted), bool), np.zeros(len(moved), bool)])),
                    pa.array(np.concatenate([np.array([copies[linked[k]].sum() for k in counted], dtype=np.int64), zero])),
                    pa.array(np.concatenate([linked[counted].sum(axis=1, dtype=np.int64), zero])),
                ],
                ["node", "other", "links", "text_links"],
            )

    return run


def in_blocks(df: DataFrame, size: str, block: int, least: int | None = None, work: float | None = None) -> DataFrame:
    """Adds i, j, side: a group of up to ``block`` rows is one pair (0, 0); of a larger one each row goes to every pair of its block.

    ``work``: how many pairs a task should have. A group of more is cut finer than it must be, into blocks of no fewer than ``least`` rows.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    if least and work:
        n = F.greatest(n, F.least(F.ceil(F.col(size) / F.lit(least)), F.ceil(F.col(size) * F.lit(sqrt(2 / max(work, 1.0))))).cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    df = df.withColumn("n_blocks", n).withColumn("own", F.when(F.col("n_blocks") > 1, own).otherwise(0))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return (
        df.withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .drop("n_blocks", "own", "other")
    )


def print_of(text: Column) -> Column:
    """A hash of the text as it is: with the id it tells rows apart, where ids are repeated or null."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def classified(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, bands: int, rows: int, tolerance: float, block: int, verify_block: int) -> tuple[DataFrame, DataFrame]:
    """(id, print, node, signature) of each row, and (node, copies, id, print, links, text_links, root) of each node.

    A node's id and print are those of the row that stands for it: the smallest id, nulls last, then the smallest print.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.withColumn("print", print_of(F.col("text")))
    signed = written(map_arrow(texts, sign(ngram, bands, rows), "id bigint, print bigint, node bigint, check bigint, signature array<bigint>"), "signed")
    signed = told_apart(signed)
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("lead")
    nodes = signed.groupBy("node").agg(F.count("*").alias("copies"), lead, *[F.first(c).alias(c) for c in ("check", "signature")])
    nodes = written(nodes.select("node", "check", "copies", "lead.id", "lead.print", "signature"), "nodes")

    places = nodes.select("node", F.posexplode("signature").alias("band", "value"))
    places = places.select("node", "band", F.xxhash64("value", "band").alias("bucket"))
    full = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = places.join(full, "bucket").join(nodes.select("node", "signature"), "node")
    pairs = in_blocks(met, "size", block).select("bucket", "i", "j", "band", "side", "node", "signature")
    plan = least_agreements(bands * rows, threshold, tolerance, STEP)
    dealt = pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    candidates = map_arrow(dealt, prune(bands, rows, plan), "u bigint, v bigint")
    clusters = connected_components(candidates)

    wanted = written(clusters.join(nodes.select("node", "check", "copies", "id", "print"), "node"), "wanted")
    chosen = wanted.withColumnsRenamed({"id": "wanted_id", "print": "wanted_print"})
    if wanted.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    told = texts.join(chosen, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("print") == F.col("wanted_print")))
    if repeats(signed):  # one row for each node: equal texts under one id
        told = told.dropDuplicates(["node"])
    told = told.select("node", "check", "copies", "root", "text")
    sets = written(map_arrow(told, hash_sets(ngram), "node bigint, copies bigint, root bigint, shingles array<bigint>"), "sets", "none")
    weight = F.greatest(F.count("*"), F.floor(F.sum(F.size("shingles")) / ROW_SHINGLES)).alias("size")
    sizes = written(sets.groupBy("root").agg(weight), "sizes")
    work = (sizes.agg(F.sum(F.col("size").cast("double") ** 2)).first()[0] or 0.0) / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = in_blocks(sets.join(sizes, "root"), "size", verify_block, min(verify_block, VERIFY_LEAST), work).select("root", "i", "j", "side", "node", "copies", "shingles")
    dealt = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = written(map_arrow(dealt, verify(threshold), "node bigint, other bigint, links bigint, text_links bigint"), "verified")

    classes = connected_components(verified.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    known = nodes.select("node", "copies", "id", "print").join(links, "node", "left").join(classes, "node", "left")
    known = known.select("node", "copies", "id", "print", "links", "text_links", F.coalesce("root", "node").alias("root"))
    return signed, written(known, "known")


def told_apart(signed: DataFrame) -> DataFrame:
    """Gives another node to texts whose digests agree in the first half only, which hardly ever happens."""
    halves = signed.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most")
    if halves.isEmpty():
        return signed
    joined = signed.join(halves.select(F.col("node").alias("of"), "least"), F.col("node") == F.col("of"), "left")
    other = F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return written(joined.withColumn("node", other).drop("of", "least"), "signed")


def repeats(signed: DataFrame) -> bool:
    """Whether any row has the id and text of another."""
    return not signed.groupBy("id", "print").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    verify_block: int = VERIFY_BLOCK,
) -> DataFrame:
    """One row per input row: id, node, class_id, n_links, n_text_links, n_copies.

    class_id is the smallest id of the rows connected by similarity of at least ``threshold``; n_links counts the other rows
    linked to this one, copies included; n_text_links the linked different texts; n_copies the rows of an equal word sequence.
    Null texts are empty; null ids are kept (a class of null ids only has a null class_id); repeated rows are copies;
    further columns are ignored; an empty table gives an empty result.
    """
    signed, known = classified(docs, id_col, text_col, ngram, threshold, bands, rows, tolerance, block, verify_block)
    firsts = known.where("links is not null").groupBy("root").agg(F.min("id").alias("first"))
    facts = known.join(firsts, "root", "left").select(
        "node",
        F.coalesce("first", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        F.col("copies").alias("n_copies"),
    )
    return signed.select("id", "node").join(facts, "node").select("id", "node", "class_id", "n_links", "n_text_links", "n_copies")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    verify_block: int = VERIFY_BLOCK,
) -> DataFrame:
    """The documents without near duplicates: exactly one row of each class stays, of the smallest id (null only if all are).

    Every column of the input is kept. Rows of a repeated or null id are told apart by their texts, so each class keeps a row of its own.
    """
    signed, known = classified(docs, id_col, text_col, ngram, threshold, bands, rows, tolerance, block, verify_block)
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("lead")
    several = known.where("copies > 1 or links is not null")
    leads = written(several.groupBy("root").agg(lead).select("root", F.struct("lead.id", "lead.print").alias("lead")), "leads")
    classes = written(signed.select("id", "print", "node").join(several.select("node", "root"), "node"), "classes").join(leads, "root")
    go = classes.where(~F.struct("id", "print").eqNullSafe(F.col("lead"))).select(F.col("id").alias("__go"), F.col("print").alias("__go_print"))
    go = written(go.distinct(), "go")
    if go.count() <= BROADCAST_ROWS:  # two longs a row
        go = F.broadcast(go)
    key, mark = free_name(docs, "id"), free_name(docs, "print")
    named = docs.withColumns({key: F.col(f"`{id_col}`").cast("bigint"), mark: print_of(F.col(f"`{text_col}`"))})
    kept = named.join(go, F.col(key).eqNullSafe(F.col("__go")) & (F.col(mark) == F.col("__go_print")), "left_anti")
    if repeats(signed):
        kept = kept.dropDuplicates([key, mark])
    return kept.drop(key, mark)
