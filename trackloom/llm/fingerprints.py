"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A text is a bag of words, each weighted by its number of occurrences. For sample k, a word draws r and c from Gamma(2, 1) and b from a
uniform distribution, all from hashes of (word, k); with weight w it has t = floor(ln w / r + b) and the value
ln c - r * (t - b + 1), and the word of the least value, with its t, is the sample. Two bags have equal samples with
probability sum(min) / sum(max) of their weights, the generalised Jaccard similarity, so the share of equal samples estimates it.

Texts meet their successors in buckets of id ranges; from there on all steps group by rows of one bucket, so nothing is
shuffled twice: words are counted by (text, word), the texts of a block that use a word are gathered, so its samples are drawn once for all of them,
``CHUNK`` at a time, and samples are minima of packed longs, the upper half of which orders the value while the lower half is the hash of word and t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import range_pieces

SAMPLES, CHUNK = 64, 8
#: Neighbouring rows of a bucket that share the draws of a word: they bound what is gathered for one word.
BLOCK = 2048
#: Whose word it is.
TEXT, EDITED, BOTH = 0, 1, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Constants of the fixed-point rank: the value is at least -128.
LOWEST, STEPS = 128.0, 8388608.0


def uniform(bits: Column, right: int, width: int) -> Column:
    """The given bits of a hash as a number between 0 and 1, never either."""
    part = F.shiftrightunsigned(bits, right).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return (part + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def logarithm(x: Column) -> Column:
    """Of a positive number. Spark takes it for nullable, which would put a test for null into each step of the innermost loop."""
    return F.coalesce(F.ln(x), F.lit(0.0))


def draws(term: Column, chunk: Column, j: int) -> list[Column]:
    """r{j}, c{j}, b{j} of a word for sample chunk * CHUNK + j; c as its logarithm. Gamma(2, 1) is minus the log of two uniforms' product."""
    one, two = (F.xxhash64(term.bitwiseXOR(F.shiftleft(chunk.cast("bigint"), 48)), F.lit(2 * j + i)) for i in range(2))
    r = -logarithm(uniform(one, 0, 32) * uniform(one, 32, 32))
    c = logarithm(-logarithm(uniform(two, 0, 21) * uniform(two, 21, 21)))
    return [r.alias(f"r{j}"), c.alias(f"c{j}"), uniform(two, 42, 22).alias(f"b{j}")]


def packed(term: Column, log: Column, r: Column, c: Column, b: Column) -> Column:
    """The candidate of a word whose weight has the given logarithm."""
    t = F.coalesce(F.floor(log / r + b), F.lit(0).cast("bigint"))
    rank = ((c - r * (t - b + 1.0) + F.lit(LOWEST)) * F.lit(STEPS)).cast("bigint")
    own = term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
    return F.shiftleft(rank, 32).bitwiseOR(own)


def in_order(texts: DataFrame) -> DataFrame:
    """(bucket, guest, row, id, text, next_text), rows counted from 1 in each bucket: each text and the next in ascending order of (id, hash of the text, text), the first after the last.

    Buckets are ranges of that order, a few for each partition: an id that fills several has as many of its own, and so have rows without one. The first text
    of each bucket is also the one guest at the end of the bucket before, so every text finds its successor in its own bucket. Rows of equal id and equal text stay together.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    spread = F.col("hash").cast("double") / float(1 << 64) + 0.5
    bucketed = hashed.withColumn("bucket", range_pieces(hashed, "id", "text", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), spread))
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "hash")
    firsts = sorted(bucketed.groupBy("bucket").agg(F.min(place).alias("x")).select("bucket", "x.id", "x.hash").collect())  # a row for each bucket
    before = [(r.bucket, r.id, r.hash, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    lead = F.broadcast(spark.createDataFrame(before, "of int, lead_id bigint, lead_hash bigint, host int"))
    leads = (F.col("bucket") == F.col("of")) & F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("hash") == F.col("lead_hash"))
    guests = bucketed.join(lead, leads).select(F.col("host").alias("bucket"), F.lit(True).alias("guest"), "id", "hash", "text").groupBy("bucket", "guest", "id", "hash").agg(F.min("text").alias("text"))
    placed = bucketed.select("bucket", F.lit(False).alias("guest"), "id", "hash", "text").unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "hash", "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).withColumn("row", F.row_number().over(order)).drop("hash")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(equal) / F.lit(float(SAMPLES))


def text_of(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def in_use(counted: DataFrame) -> DataFrame:
    """(head, term, bucket, block, uses) from (bucket, row, term, n0, n1): the words of a block of rows, each once, with the (owner, log) of all its uses.

    An owner is 4 * row + TEXT, EDITED or BOTH. The uses are two for each row of a block at most.
    """
    # most words weigh the same in a text and its edited text, and are then drawn once for both
    each = [F.struct(F.lit(k).alias("of"), F.col(f"n{min(k, 1)}").alias("n")) for k in (TEXT, EDITED, BOTH)]
    weighed = counted.select("bucket", "row", "term", F.explode(F.when(F.col("n0") == F.col("n1"), F.array(each[BOTH])).otherwise(F.array(*each[:BOTH]))).alias("x")).where("x.n > 0")
    use = F.struct((F.col("row") * 4 + F.col("x.of")).alias("owner"), logarithm(F.col("x.n").cast("double")).alias("log")).alias("use")
    block = F.floor(F.col("row") / BLOCK).cast("int").alias("block")
    # rows are grouped by sorting them: a first key of both bucket and word settles nearly all comparisons by its prefix
    head = F.shiftleft(F.col("bucket").cast("bigint"), 40).bitwiseXOR(F.shiftrightunsigned("term", 24)).alias("head")
    return weighed.select(head, "term", "bucket", block, use).groupBy("head", "term", "bucket", "block").agg(F.collect_list("use").alias("uses"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next text. Null texts are
    empty; texts without words have one fingerprint of their own, equal among themselves and unlike all others; null ids come first;
    rows of one id are in order of a hash of their texts; a single row is its own successor; further columns are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ordered = in_order(texts)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    ordered = ordered.withColumn("n_chars", n.cast("bigint"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    ordered = ordered.withColumn("edited", edited)
    keys = ["bucket", "row"]
    # rows are counted in a total order, so the facts of a text find its samples again and needn't go along with each of its words
    facts = ordered.select(*keys, "guest", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = ordered.select(*keys, F.explode(F.array(F.struct(F.lit(TEXT).alias("tag"), F.col("text").alias("of")), F.struct(F.lit(EDITED).alias("tag"), F.col("edited").alias("of")))).alias("x"))
    words = both.select(*keys, "x.tag", F.explode(F.split(F.lower("x.of"), SEPARATORS)).alias("word")).where(F.col("word") != "")
    counted = words.select(*keys, "tag", F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(*[F.count_if(F.col("tag") == k).alias(f"n{k}") for k in (TEXT, EDITED)])
    chunks = in_use(counted).select("bucket", "term", "uses", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // CHUNK - 1))).alias("chunk"))
    drawn = chunks.select("*", *[x for j in range(CHUNK) for x in draws(F.col("term"), F.col("chunk"), j)])
    drawn = drawn.select("*", F.explode("uses").alias("use"))
    least = [F.min(packed(F.col("term"), F.col("use.log"), *(F.col(f"{x}{j}") for x in "rcb"))).alias(f"w_{j}") for j in range(CHUNK)]
    drawn = drawn.groupBy("bucket", "use.owner", "chunk").agg(*least).withColumn("row", F.floor(F.col("owner") / 4).cast("int"))
    least = [F.min(F.when((F.col("owner") % 4).isin(k, BOTH), F.col(f"w_{j}"))).alias(f"w{k}_{j}") for j in range(CHUNK) for k in (TEXT, EDITED)]
    drawn = drawn.groupBy(*keys, "chunk").agg(*least)
    low = F.lit((1 << 32) - 1).cast("bigint")
    taken = lambda w: F.array(*[F.coalesce(F.col(f"{w}_{j}").bitwiseAND(low), F.lit(0).cast("bigint")) for j in range(CHUNK)])
    drawn = drawn.select(*keys, F.struct("chunk", taken("w0").alias("w0"), taken("w1").alias("w1")).alias("piece"))
    # a text without words has its facts alone, and zeros as samples
    known = ["guest", "id", "n_chars", "edited_sha256"]
    joined = drawn.unionByName(facts, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(x).alias(x) for x in known], F.sort_array(F.collect_list("piece")).alias("all"))
    none = F.array_repeat(F.lit(0).cast("bigint"), SAMPLES)
    lists = [F.when(F.size("all") > 0, F.flatten(f"all.{w}")).otherwise(none).alias(w) for w in ("w0", "w1")]
    drawn = joined.select(*keys, *known, *lists)
    following = F.lead("w0").over(Window.partitionBy("bucket").orderBy("row"))
    drawn = drawn.withColumn("following", following).where(~F.col("guest"))
    return drawn.select(
        "id", "n_chars", "edited_sha256", text_of(F.col("w0")).alias("fingerprint"), text_of(F.col("w1")).alias("edited_fingerprint"),
        likeness(F.col("w0"), F.col("w1")).alias("near_edited"), likeness(F.col("w0"), F.col("following")).alias("near_next"),
    )
