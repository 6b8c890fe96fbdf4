"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets.

A document's set is that of its shingles of ``ngram`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), of all its words as one where it has fewer, and empty without
words. Two documents are linked if 100 times their intersection is at least ``percent`` times their union; empty sets are linked with nothing. Documents of
equal sets are one node, told by a 128-bit digest of the set, and are never expanded into pairs.

1. A register holds floor(1 - log_b h) of the least of the shingles' exponential hash values, cut to 0..65535: exponentially spaced, truncated minima. The larger of
   two registers is that of the union (``merge_sketches``), and equal registers tell of common shingles.
2. ``ROWS`` registers are a band, packed into one long. Nodes with an equal band meet in a bucket; of buckets with the same members one is kept. In a
   bucket, pairs that aren't connected yet are dropped by sizes, by agreement in some registers, and by the likelihood of the similarity given how many registers are larger, smaller and equal
   (``joint_estimate``): a pair goes if the threshold is less likely than the best value by a factor that a linked pair exceeds with a chance of ``TOLERANCE``. What stays leaves as a spanning forest.
3. Of each cluster of the survivors, the shingle sets are written once and compared with a leader's, in plain joins; what isn't linked to the first leader is compared with a second.
   In clusters that these don't settle, all members of other parts than the largest are compared with all members, dealt out by the sizes of sets as pairs of blocks.
   So a group of n near copies takes n comparisons, no group is capped, and no pair between different parts is left out.

With 24 bands of 4 a pair of similarity exactly 0.8 meets with probability 1 - 3e-6, as registers agree at least as often as MinHash values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import UNSPACED, U, blocks
from .components import connected_components
from .near_duplicates import Forest, grouped, in_blocks, least_agreements, print_of, repeats, seeds, told_apart
from .tables import free_name, map_arrow, written

NGRAM, PERCENT, BANDS, ROWS = 2, 80, 24, 4
#: The base of the registers' spacing, the rate of the exponential hash values, and the largest register.
SPACING, RATE, LARGEST = 1.001, 20.0, 65535
#: The chance that a linked pair is dropped, and by how much its log-likelihood may then fall short of the best; registers compared first.
TOLERANCE, SHORT, FIRST = 1e-6, 11.3, 32
#: Rows of a bucket's block; sets and shingles of a block of sets to verify; leaders that each cluster is compared with.
BLOCK, SETS, SHINGLES, LEADERS = 8192, 512, 1_000_000, 2
BROADCAST_ROWS = 500_000


def registers_of(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The registers of each set of shingle hashes; sets mustn't be empty."""
    xor, times = seeds(count)
    out = np.zeros((len(sets), count), dtype=np.uint16)
    if not sets:
        return out
    values, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    for k in range(count):
        low = np.minimum.reduceat((values ^ xor[k]) * times[k], at)
        least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(least) / np.log(SPACING)), 0, LARGEST).astype(np.uint16)
    return out


def share(x: np.ndarray) -> np.ndarray:
    """The chance that one of two registers is larger, where x is the part of the union that only its set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)


def log_likelihood(j: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of the similarity j of sets of sizes n and m, given how many registers of the first are larger, smaller and equal."""
    u, v = n / (n + m), m / (n + m)
    up, down = share(u - v * j), share(v - u * j)
    return sum(k * np.log(np.maximum(p, 1e-300)) for k, p in ((larger, up), (smaller, down), (equal, 1 - up - down)))


def joint_estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 40) -> np.ndarray:
    """The likeliest similarity of each pair, by golden sections of its range: it is at most the smaller size over the larger."""
    low, high, golden = np.zeros(len(n)), np.minimum(n, m) / np.maximum(n, m), (5**0.5 - 1) / 2
    for _ in range(steps):
        a, b = high - golden * (high - low), low + golden * (high - low)
        right = log_likelihood(a, larger, smaller, equal, n, m) < log_likelihood(b, larger, smaller, equal, n, m)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def plausible(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, percent: int, first: tuple[int, int]) -> np.ndarray:
    """Which of the other sketches may be linked with one: by sizes for certain, by agreements and likelihood but for ``TOLERANCE``."""
    on = np.flatnonzero(100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes))
    on = on[(others[on, : first[0]] == one[: first[0]]).sum(axis=1) >= first[1]]
    if not len(on):
        return on
    larger, smaller = (one > others[on]).sum(axis=1), (one < others[on]).sum(axis=1)
    told = larger, smaller, len(one) - larger - smaller, np.full(len(on), float(size)), sizes[on].astype(float)
    at = np.full(len(on), percent / 100)
    keep = log_likelihood(at, *told) >= log_likelihood(at - 1e-4, *told)  # the curve has one top: it lies at the threshold or above
    if not keep.all():
        told = tuple(x[~keep] for x in told)
        keep[~keep] = log_likelihood(joint_estimate(*told), *told) - log_likelihood(at[~keep], *told) <= SHORT
    return on[keep]


def shingle_sets(column: pa.Array, ngram: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    sets = []
    for block in blocks(column):
        block.find_words(UNSPACED).hash_words().hash_shingles(ngram)
        sets += [np.unique(block.shingles[a:b]) for a, b in zip(block.shingle_at[:-1], block.shingle_at[1:], strict=True)]
    return sets


def sign(ngram: int, bands: int, rows: int):
    """mapInArrow: (id, text, print) -> (id, print, n_shingles, node, check, registers); no node where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), ngram)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = sizes > 0
            halves = np.zeros((len(sets), 2), dtype=np.int64)
            halves[full] = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets if len(s)), dtype="<i8").reshape(-1, 2)
            packed = np.zeros((len(sets), bands), dtype=np.int64)
            packed[full] = registers_of([s for s in sets if len(s)], bands * rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(packed.reshape(-1)))
            node, check = (pa.array(halves[:, k], mask=~full) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), node, check, lists], ["id", "print", "n_shingles", "node", "check", "registers"])

    return run


def meet(bands: int, rows: int, percent: int):
    """mapInArrow over rows sorted by (bucket, i, j): (bucket, i, j, band, side, node, n_shingles, registers) -> (u, v), a spanning forest of the plausible pairs."""
    first = least_agreements(FIRST, percent / 100, TOLERANCE / 10, FIRST)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for (_, i, j), rows_of in grouped(batches, 3):
            if rows_of.num_rows < 2:
                continue
            side, nodes, sizes = (rows_of[c].to_numpy() for c in ("side", "node", "n_shingles"))
            lists = rows_of["registers"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            packed = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), bands)
            order = np.argsort(side, kind="stable")
            nodes, sizes, packed = nodes[order], sizes[order], np.ascontiguousarray(packed[order])
            values, band, cut = packed.view(np.uint16).reshape(len(nodes), -1), rows_of["band"][0].as_py(), int((side == 0).sum())
            forest = Forest(len(nodes))
            for row in range(len(nodes) if i == j else cut):
                low = row + 1 if i == j else cut
                others = low + np.flatnonzero(forest.label[low:] != forest.label[row])
                if band and len(others):  # pairs that met in an earlier band were compared there
                    others = others[~(packed[others, :band] == packed[row, :band]).any(axis=1)]
                if len(others):
                    others = others[plausible(values[row], values[others], int(sizes[row]), sizes[others], percent, first)]
                if len(others):
                    forest.join(row, others)
            moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
            if len(moved):
                found.append((nodes[moved], nodes[forest.label[moved]]))
            if len(found) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

    return run


def hash_sets(ngram: int):
    """mapInArrow: (node, root, text) -> (node, root, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), ngram)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for s in sets)]), pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["node", "root", "shingles"])

    return run


def common(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: shingles that only one side has are left out, the rest multiply in slices of columns."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    places = []
    for values, sets in ((a, left), (b, right)):
        owner, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(shared, values)
        held = (column < len(shared)) & (shared[np.minimum(column, max(0, len(shared) - 1))] == values) if len(shared) else np.zeros(len(values), dtype=bool)
        order = np.argsort(column[held], kind="stable")
        places.append((owner[held][order], column[held][order]))
    for low in range(0, len(shared), width):
        parts = []
        for (owner, column), sets in zip(places, (left, right), strict=True):
            x, y = np.searchsorted(column, [low, low + width])
            part = np.zeros((len(sets), min(width, len(shared) - low)), dtype=np.float32)
            part[owner[x:y], column[x:y] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def settle(percent: int):
    """mapInArrow over rows sorted by (root, i, j): (root, i, j, side, part, shingles) -> (u, v), a spanning forest of the parts that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 3):
            side, part = rows["side"].to_numpy(), rows["part"].to_numpy()
            sets = [np.asarray(s.values) for s in rows["shingles"]]
            sides = [np.flatnonzero(side == k) for k in range(2)]
            if not len(sides[0]) or not len(sides[1]):
                continue
            left, right = ([sets[k] for k in own] for own in sides)
            both = common(left, right).astype(np.float64)
            union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
            x, y = np.nonzero(100 * both >= percent * union)
            u, v = part[sides[0]][x], part[sides[1]][y]
            names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
            u, v = places[: len(u)], places[len(u) :]
            forest = Forest(len(names))
            for k in np.unique(u):
                forest.join(int(k), v[u == k])
            moved = np.flatnonzero(forest.label != np.arange(len(names)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[forest.label[moved]])], ["u", "v"])

    return run


def linked(a: Column, b: Column, percent: int) -> Column:
    """Whether two arrays of distinct shingles are linked."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def led(sets: DataFrame, percent: int, leaders: int) -> DataFrame:
    """(root, node, part): the parts of each cluster that are linked to one of its leaders; nodes that aren't are parts of their own."""
    spark, settled = sets.sparkSession, None
    left = sets.select("root", "node")
    for _ in range(leaders):
        chosen = left.groupBy("root").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
        if chosen.isEmpty():
            break
        own = sets.join(left, ["root", "node"]).join(chosen, "root")
        theirs = own.where("node = leader").select("root", F.col("shingles").alias("theirs"))
        met = own.join(theirs, "root").select("root", "node", "leader", linked(F.col("shingles"), F.col("theirs"), percent).alias("linked"))
        met = written(met, "met")
        parts = met.where("linked").select("root", "node", F.col("leader").alias("part"))
        settled = parts if settled is None else settled.union(parts)
        left = written(left.join(parts.select("root", "node"), ["root", "node"], "left_anti"), "left")
    rest = left.select("root", "node", F.col("node").alias("part"))
    return written(rest if settled is None else settled.union(rest), "parts")


def dealt(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows for ``settle``: in clusters of several parts, each set outside the largest part, and each set, in all pairs of their blocks.

    Blocks are cut by numbers of sets and of shingles; sets of the largest part go to as many blocks as the others fill, and the others to as many as all fill.
    """
    counts = parts.groupBy("root", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("root").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts"))
    main = main.where("parts > 1 and all > 2").select("root", F.col("most.part").alias("main"))  # two were compared
    rows = sets.join(parts.join(main, "root"), ["root", "node"]).withColumn("minor", F.col("part") != F.col("main"))
    rows = written(rows, "unsettled")
    long = F.size("shingles")
    weigh = lambda when: F.greatest(F.ceil(F.count(F.when(when, 1)) / SETS), F.ceil(F.sum(F.when(when, long).otherwise(0)) / SHINGLES), F.lit(1)).cast("int")
    cuts = written(rows.groupBy("root").agg(weigh(F.col("minor")).alias("n_minor"), weigh(F.lit(True)).alias("n_all")), "cuts")
    rows = rows.join(cuts, "root")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(12)), F.col(n)).cast("int")
    counted = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("minor").select("root", own("n_minor").alias("i"), counted("n_all").alias("j"), F.lit(0).alias("side"), "part", "shingles")
    right = rows.select("root", own("n_all").alias("j"), counted("n_minor").alias("i"), F.lit(1).alias("side"), "part", "shingles")
    return left.unionByName(right)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = NGRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, print, n_shingles, node, check, registers) of each row; registers are packed, ``rows`` of 16 bits to a long."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.withColumn("print", print_of(F.col("text")))
    return map_arrow(texts, sign(ngram, bands, rows), "id bigint, print bigint, n_shingles bigint, node bigint, check bigint, registers array<bigint>")


def unpacked(registers: Column, rows: int = ROWS) -> Column:
    """The registers as an array of integers."""
    return F.flatten(F.transform(registers, lambda band: F.array(*[F.shiftrightunsigned(band, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(rows)])))


def merge_sketches(sketches: DataFrame, by: str, count: int = BANDS * ROWS, registers: str = "registers") -> DataFrame:
    """(by, registers): the sketch of the union of the sets of each group, by the largest of each register, so groups are pre-aggregated. Registers unpacked."""
    largest = sketches.withColumn(registers, unpacked(F.col(registers))).groupBy(by).agg(*[F.max(F.get(registers, F.lit(k))).alias(f"r{k}") for k in range(count)])
    return largest.select(by, F.array(*[f"r{k}" for k in range(count)]).alias(registers))


def cardinality(registers: Column) -> Column:
    """The estimated size of the set of a sketch, of its unpacked registers."""
    total = F.aggregate(registers, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(SPACING), -k))
    return F.size(registers) * (1 - 1 / SPACING) / (RATE * float(np.log(SPACING)) * total)


def labelled(docs: DataFrame, id_col: str, text_col: str, ngram: int, percent: int, bands: int, rows: int, block: int, leaders: int) -> tuple[DataFrame, DataFrame]:
    """(id, print, n_shingles, node) of each row, and (node, label, id, print) of each node; nodes of one component have one label.

    A node's id and print are those of the row that stands for it: the smallest id, nulls last, then the smallest print.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("print", print_of(F.col("text")))
    signed = told_apart(written(sketched(docs, id_col, text_col, ngram=ngram, bands=bands, rows=rows), "signed"))
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("lead")
    nodes = signed.where("node is not null").groupBy("node").agg(lead, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = written(nodes.select("node", "n_shingles", "lead.id", "lead.print", "registers"), "nodes")

    places = nodes.select("node", F.posexplode("registers").alias("band", "value")).select("node", "band", F.xxhash64("value", "band").alias("bucket"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"members{k}") for k in range(2)]
    full = places.groupBy("bucket").agg(F.count("*").alias("size"), F.min("band").alias("band"), *members).where("size > 1")
    full = full.groupBy("size", "members0", "members1").agg(F.min(F.struct("band", "bucket")).alias("one")).select("one.bucket", "size")
    met = places.join(full, "bucket").join(nodes.select("node", "n_shingles", "registers"), "node")
    pairs = in_blocks(met, "size", block).select("bucket", "i", "j", "band", "side", "node", "n_shingles", "registers")
    # so many tasks, however few bytes: pairs cost more than their rows tell
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    clusters = connected_components(map_arrow(pairs, meet(bands, rows, percent), "u bigint, v bigint"))

    wanted = written(clusters.join(nodes.select("node", "id", "print"), "node"), "wanted")
    chosen = wanted.withColumnsRenamed({"id": "wanted_id", "print": "wanted_print"})
    if wanted.count() <= BROADCAST_ROWS:  # four longs a row
        chosen = F.broadcast(chosen)
    told = texts.join(chosen, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("print") == F.col("wanted_print")))
    if repeats(signed):
        told = told.dropDuplicates(["node"])
    sets = written(map_arrow(told.select("node", "root", "text"), hash_sets(ngram), "node bigint, root bigint, shingles array<bigint>"), "sets", "none")

    parts = led(sets, percent, leaders)
    rest = dealt(sets, parts).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "side", "part", "shingles")
    joined = written(map_arrow(rest, settle(percent), "u bigint, v bigint"), "joined")
    label = F.col("part")
    if not joined.isEmpty():
        over = connected_components(joined).withColumnRenamed("root", "over")
        parts, label = parts.drop("root").join(over.withColumnRenamed("node", "of"), F.col("part") == F.col("of"), "left"), F.coalesce("over", "part")
    named = parts.select("node", label.alias("label"))
    known = nodes.select("node", "id", "print").join(named, "node", "left").select("node", "id", "print", F.coalesce("label", "node").alias("label"))
    return signed.select("id", "print", "n_shingles", "node"), written(known, "known")


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ngram: int = NGRAM,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    leaders: int = LEADERS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    component_id is the smallest id of the rows reachable by links; rows without words are components of their own, whatever their texts. Null texts are empty; null ids
    come after all others: a component of null ids only has a null component_id. kept: the row's id is its component's, so of
    repeated ids all are kept. Further columns are ignored; an empty table gives an empty result.
    """
    signed, known = labelled(docs, id_col, text_col, ngram, percent, bands, rows, block, leaders)
    firsts = written(known.groupBy("label").agg(F.min("id").alias("component_id")), "firsts")
    facts = known.select("node", "label").join(firsts, "label").select(F.col("node").alias("of"), "component_id")
    told = signed.where("node is not null").join(facts, F.col("node") == F.col("of")).select("id", "n_shingles", "component_id")
    alone = signed.where("node is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return told.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def without_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ngram: int = NGRAM,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    leaders: int = LEADERS,
) -> DataFrame:
    """The documents themselves, with all their columns: exactly one row of each component, of the smallest id (null only if all are), then of the smallest hash of its text.

    Rows without words all stay. Rows of a repeated or null id are told apart by their texts.
    """
    signed, known = labelled(docs, id_col, text_col, ngram, percent, bands, rows, block, leaders)
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("lead")
    leads = written(known.groupBy("label").agg(lead).select("label", F.struct("lead.id", "lead.print").alias("lead")), "leads")
    rows_of = signed.where("node is not null").select("id", "print", "node").join(known.select("node", "label"), "node").join(leads, "label")
    go = written(rows_of.where(~F.struct("id", "print").eqNullSafe(F.col("lead"))).select(F.col("id").alias("__go"), F.col("print").alias("__go_print")).distinct(), "go")
    if go.count() <= BROADCAST_ROWS:  # two longs a row
        go = F.broadcast(go)
    key, mark = free_name(docs, "id"), free_name(docs, "print")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(worded).withColumns({key: F.col(f"`{id_col}`").cast("bigint"), mark: print_of(F.col(f"`{text_col}`"))})
    kept = named.join(go, F.col(key).eqNullSafe(F.col("__go")) & (F.col(mark) == F.col("__go_print")), "left_anti")
    if repeats(signed.where("node is not null")):
        kept = kept.dropDuplicates([key, mark])
    return kept.drop(key, mark).unionByName(docs.where(~worded))


#: The same components in DuckDB, by all pairs of documents with a common shingle.
COPIES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), numbered AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON w.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
