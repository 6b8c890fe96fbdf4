"""Token-ID output: ids of each document, compressed on its own with a shared zstandard dictionary.

A dataset is a folder with two tables, written by Spark on any store it knows.

* ``dictionary``: one row (sha256, dictionary bytes, tokenizer, end_id). The dictionary is trained on the serialized id arrays of at most
  ``SAMPLE`` whole documents with ``SAMPLE_BYTES`` bytes of text together.
* ``shards``: rows of about ``SHARD_BYTES`` (piece, seq, dictionary_sha256, doc_ids, offsets, n_tokens, payload) in ascending order of the document id.
  payload holds one zstandard frame for each document, of its ids as little-endian unsigned 32-bit integers; offsets[k] is
  where document k's frame begins and offsets[k + 1] where it ends. A frame of ``SHARD_BYTES`` or more has a shard of its own.

One document is read by its shard's index columns and one slice of the payload; a frame whose dictionary hash differs is refused.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import U, Block, blocks, mix
from .tables import hashed_sample, map_arrow, range_pieces

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, SHARD_BYTES, PIECES, LEVEL, END_ID = 2000, 4 << 20, 64 << 10, 4 << 20, 64, 3, 0
#: What a Python worker keeps of pieces of text met before: so many slots, and ids before it starts afresh; bytes of a piece that two longs tell.
SLOT_BITS, KEPT, SHORT = 20, 4 << 20, 15
SLOTS = 1 << SLOT_BITS
#: The lowest k bytes of a long.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
IDS = "id bigint, n bigint, frame binary"
SHARDS = "piece int, seq bigint, dictionary_sha256 string, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>, payload binary"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file; the tokenizers' folder is that of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions that begin a word of the byte-level pre-tokenizer whatever surrounds them.

    These are: an ASCII space or line end after a visible character (ASCII, or a letter of the Latin-1 block), an ASCII mark after an ASCII
    letter or digit or a letter of the Latin-1 block, a visible ASCII character after a line end that itself follows a visible one, and every document's
    begin. No pre-token spans such a position and none looks across it, so the pieces between them can be encoded one by one.
    """
    visible, alnum = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    visible[0x21:0x7F] = True
    alnum[48:58] = alnum[65:91] = alnum[97:123] = True
    n = len(raw)
    start = np.zeros(n, dtype=bool)
    if n > 1:
        letter = np.zeros(n, dtype=bool)  # the last byte of a letter from U+00C0 to U+00FF
        letter[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        seen, own = visible[raw], alnum[raw]
        mark = seen & ~own
        line = raw == 0x0A
        start[1:] = (((raw[1:] == 0x20) | line[1:]) & (seen | letter)[:-1]) | (mark[1:] & (own | letter)[:-1])
        start[2:] |= seen[2:] & line[1:-1] & (seen | letter)[:-2]
    start[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of documents by the tokenizers library; short pieces of text that were met before aren't encoded again.

    A piece of at most ``SHORT`` bytes is told exactly by two longs, which hold its bytes and their number. They are kept in a table of
    ``SLOTS`` pieces: a piece whose two slots hold others is encoded and takes the second, so memory is bounded and no id depends on a hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.low, self.high = np.zeros(SLOTS, dtype=U), np.zeros(SLOTS, dtype=U)
        self.begin, self.length = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.uint8)
        self.forget(KEPT)

    def forget(self, size: int) -> None:
        self.high[:] = 0  # of no piece: the highest byte is the number of bytes
        self.ids, self.used = np.zeros(size, dtype=np.uint32), 0

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin in the table's ids, and how many they are."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.array([len(x) for x in found], dtype=np.int64)
        total = int(length.sum())
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total)
        begin = self.used + np.cumsum(length) - length
        self.used += total
        return begin, length

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in order, and where each document's ids begin."""
        if self.used + len(raw) > len(self.ids):  # a byte has one id at most
            self.forget(max(KEPT, len(raw)))
        starts = piece_starts(raw, offsets)
        sizes = np.diff(np.append(starts, len(raw)))
        short = sizes <= SHORT
        eight = np.ndarray(len(raw) + 9, dtype="<u8", buffer=np.concatenate([raw, np.zeros(16, dtype=np.uint8)]), strides=(1,))
        low = eight[starts] & MASKS[np.minimum(sizes, 8)]
        high = (eight[starts + 8] & MASKS[np.clip(sizes - 8, 0, 7)]) | (np.minimum(sizes, 255).astype(U) << U(56))
        mixed = mix(low ^ mix(high))
        slot = (mixed >> U(64 - SLOT_BITS)).astype(np.int64)
        other = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))  # may be in its second slot
        slot[other] = (mixed[other] & U(SLOTS - 1)).astype(np.int64)
        begin, length = self.begin[slot].astype(np.int64), self.length[slot].astype(np.int64)
        new = other[~(short[other] & (self.low[slot[other]] == low[other]) & (self.high[slot[other]] == high[other]))]
        if len(new):
            data = raw.tobytes()
            pieces: dict[bytes, int] = {}
            which = np.array([pieces.setdefault(data[a : a + n], len(pieces)) for a, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)])
            at, n = self.learn([x.decode("utf-8", "replace") for x in pieces])
            begin[new], length[new] = at[which], n[which]
            keep = new[short[new]]
            first = (mixed[keep] >> U(64 - SLOT_BITS)).astype(np.int64)
            empty = self.high[first] == 0
            slot[keep[empty]] = first[empty]
            self.low[slot[keep]], self.high[slot[keep]] = low[keep], high[keep]
            self.begin[slot[keep]], self.length[slot[keep]] = begin[keep], length[keep]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)]
        return ids, upto[np.searchsorted(starts, offsets)]

    def documents(self, block: Block) -> Iterator[np.ndarray]:
        """The ids of each document. One that holds the string of an added token is encoded as one text: pieces would split the token."""
        raw, offsets = block.data, block.offsets
        ids, at = self.encode(raw, offsets)
        data, whole = raw.tobytes() if self.added else b"", set()
        for token in self.added:
            place = data.find(token)
            while place >= 0:
                whole.add(int(np.searchsorted(offsets, place, side="right")) - 1)
                place = data.find(token, place + 1)
        for d in range(len(offsets) - 1):
            if d in whole:
                text = data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace")
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield ids[at[d] : at[d + 1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def serialized(column: pa.Array, path: str, end_id: int) -> Iterator[bytes]:
    """Each text's ids with the end id, as bytes."""
    for block in blocks(column, lower=False):
        for ids in encoder(path).documents(block):
            yield np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()


def framed(batch: pa.RecordBatch, first: int, sizes: list[int], found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["id", "n", "frame"])


def frames(path: str, end_id: int, dictionary: bytes, level: int) -> Callable:
    """mapInArrow: (id, text) -> (id, n, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False)
        for batch in batches:
            found, sizes, first, held = [], [], 0, 0
            for raw in serialized(batch.column(1), path, end_id):
                sizes.append(len(raw) // 4)
                found.append(press.compress(raw))
                held += len(found[-1])
                if held > 1 << 20:
                    yield framed(batch, first, sizes, found)
                    found, sizes, first, held = [], [], first + len(sizes), 0
            yield framed(batch, first, sizes, found)

    return run


def shards(digest: str, size: int) -> Callable:
    """mapInArrow over rows sorted by (piece, id): (piece, id, n, frame) -> shard rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seq, ids, ns, held, used = None, 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            values = [[piece], [seq], [digest], [ids], [at.tolist()], [ns], [b"".join(held)]]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["piece", "seq", "dictionary_sha256", "doc_ids", "offsets", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for p, i, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != piece or used + len(frame) > size):
                    yield shard()
                    seq, ids, ns, held, used = (seq + 1 if p == piece else 0), [], [], [], 0
                elif p != piece:
                    seq = 0
                piece = p
                ids.append(i)
                ns.append(n)
                held.append(frame)
                used += len(frame)
        if held:
            yield shard()

    return run


def train(texts: DataFrame, path: str, end_id: int, sample: int, most: int, size: int) -> bytes:
    """A dictionary of the id arrays of at most ``sample`` whole documents with ``most`` bytes of text together; empty where that is too little.

    Candidates are the texts of ``sample`` ids, one for each id; in order of their hashes each goes in that still fits.
    """
    import zstandard

    ids = hashed_sample(texts.select("id").where("id is not null"), "id", sample, seed=8)
    told = F.struct(F.xxhash64("text").alias("print"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    rows = texts.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min(told).alias("told")).collect()
    chosen, used = [], 0
    for row in sorted(rows, key=lambda r: (r.told.print or 0, r.id)):
        if used + row.told.bytes <= most:
            chosen.append((row.id, row.told.print))
            used += row.told.bytes
    if not chosen:
        return b""
    chosen = F.broadcast(texts.sparkSession.createDataFrame(chosen, "id bigint, print bigint"))
    own = texts.withColumn("print", F.xxhash64("text")).join(chosen, ["id", "print"], "left_semi")
    serial = map_arrow(own.select("id", "text"), arrays(path, end_id), "id bigint, ids binary").groupBy("id").agg(F.min("ids").alias("ids"))
    try:
        return zstandard.train_dictionary(size, [bytes(r.ids) for r in sorted(serial.collect(), key=lambda r: r.id)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def arrays(path: str, end_id: int) -> Callable:
    """mapInArrow: (id, text) -> (id, ids), the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(serialized(batch.column(1), path, end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "ids"])

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    shard_bytes: int = SHARD_BYTES,
    pieces: int = PIECES,
    level: int = LEVEL,
) -> str:
    """Writes the dataset described above and returns its folder.

    Null texts are empty (one end id); null ids come first; repeated rows are written as often as they occur; further columns are
    ignored; an empty table writes an empty dataset. Documents are dealt out by id ranges, so only frames are
    shuffled, once; a null or repeated id that fills several ranges is dealt out among them by its frames.
    The dictionary is trained on whole documents, at most ``sample`` with ``sample_bytes`` bytes of text together; it forms no result.
    Invalid UTF-8 is read as U+FFFD.
    """
    path = tokenizer or vocabulary()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dictionary = train(texts, path, end_id, sample, sample_bytes, dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    header = spark.createDataFrame([(digest, bytearray(dictionary), os.path.basename(path), end_id)], "sha256 string, dictionary binary, tokenizer string, end_id int")
    header.coalesce(1).write.parquet(f"{folder}/dictionary")
    pieces = max(pieces, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    piece = range_pieces(texts, "id", "frame", pieces)
    pressed = map_arrow(texts, frames(path, end_id, dictionary, level), IDS)
    dealt = pressed.withColumn("piece", piece).repartition("piece").sortWithinPartitions("piece", "id", "n", "frame")
    map_arrow(dealt.select("piece", "id", "n", "frame"), shards(digest, shard_bytes), SHARDS).write.option("compression", "uncompressed").parquet(f"{folder}/shards")
    return folder


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(row.dictionary)
    if hashlib.sha256(raw).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary of {folder} doesn't have the hash it was written with")
    return row.sha256, raw


def unpack(digest: str, dictionary: bytes, wanted: list[int] | None, with_ids: bool) -> Callable:
    """mapInArrow: shard rows -> (piece, seq, before, id, n, crc32[, ids]); before: ids of the shard's documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=shared)
        only = None if wanted is None else set(wanted)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                if row["dictionary_sha256"].as_py() != digest:
                    raise ValueError("a shard was written with another dictionary")
                ids, at, ns = (row[c].as_py() for c in ("doc_ids", "offsets", "n_tokens"))
                before = np.concatenate([[0], np.cumsum(ns)]).tolist()
                payload = memoryview(row["payload"].as_buffer())
                out: list[list] = [[], [], [], [], [], [], []]
                for place, doc in enumerate(ids):
                    if only is None or doc in only:
                        raw = expand.decompress(payload[at[place] : at[place + 1]])
                        values = [row["piece"].as_py(), row["seq"].as_py(), before[place], doc, len(raw) // 4, zlib.crc32(raw), np.frombuffer(raw, dtype="<u4").astype(np.int64).tolist() if with_ids else None]
                        if values[4] != ns[place]:
                            raise ValueError(f"document {doc}: {values[4]} ids, but its index says {ns[place]}")
                        for o, v in zip(out, values, strict=True):
                            o.append(v)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["piece", "seq", "before", "id", "n", "crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)][: 7 if with_ids else 6], names[: 7 if with_ids else 6])

    return run


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(id, ids) of single documents: the index columns select the shards, and only the documents' own frames are expanded."""
    digest, dictionary = _dictionary(spark, folder)
    table = spark.read.parquet(f"{folder}/shards").where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)).cast("bigint") for i in doc_ids])))
    return map_arrow(table, unpack(digest, dictionary, list(doc_ids), True), "piece int, seq bigint, before bigint, id bigint, n bigint, crc32 bigint, ids array<bigint>").select("id", "ids")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the frames: start is the number of ids of all documents before it."""
    digest, dictionary = _dictionary(spark, folder)
    table = spark.read.parquet(f"{folder}/shards")
    rows = map_arrow(table, unpack(digest, dictionary, None, False), "piece int, seq bigint, before bigint, id bigint, n bigint, crc32 bigint")
    sums = table.select("piece", "seq", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
    by_piece = sums.groupBy("piece").agg(F.sum("total").alias("total"))
    upto = F.sum("total").over(Window.orderBy("piece")) - F.col("total")
    by_piece = by_piece.select(F.col("piece").alias("p"), upto.alias("piece_start"))
    within = F.sum("total").over(Window.partitionBy("piece").orderBy("seq")) - F.col("total")
    starts = sums.withColumn("shard_start", within).join(by_piece, F.col("piece") == F.col("p")).select(F.col("piece").alias("p"), F.col("seq").alias("s"), (F.col("shard_start") + F.col("piece_start")).alias("first"))
    joined = rows.join(starts, (F.col("piece") == F.col("p")) & (F.col("seq") == F.col("s")))
    return joined.select("id", (F.col("first") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
