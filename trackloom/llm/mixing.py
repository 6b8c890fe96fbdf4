"""Mixing sources to target weights: whole copies first, then Pareto order sampling. DataFrame functions only.

The size of a text is its number of ``[^\\x20\\x09-\\x0D]+``. Sources, by code point with null last, weigh 1, 2, 3, repeating
(or as given); their targets are shares of ``total`` times all sizes, at most ``most`` times the source's own size, the
excess reshared by weight. A source's ratio of target to size is its documents' expected number of copies: the whole part is
certain, and for the rest documents are drawn without replacement by Pareto order sampling: each document draws
u from a hash of its id, and the smallest (u / (1 - u)) / (p / (1 - p)) are taken while they fit into the source's remaining words; the words then missing go to
the one further document whose size is nearest to them, if that brings the source nearer to its target. p is the fraction of the
source's ratio, for each of its documents.

The order within a source is found without sorting the source: sizes are summed by ``BINS`` bins of the rank, and only the one
bin in which a source's words are met is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import column_or_null, free_name, written

BINS = 4096
#: Up to so many sources are broadcast, with a few hundred bytes each.
SOURCES = 50_000
TOKEN = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: int) -> Column:
    """52 bits of an MD5 of the key as a number between 0 and 1, never either."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, total: float = 1.0, most: int = 3, weights: dict[str | None, int] | None = None) -> DataFrame:
    """(source, source_size, target) of each source: the level at which all targets together are the total.

    A source is at its limit exactly if the level of the sources from its own limit on would exceed it, with sources ordered by
    limit over weight; this is what resharing until none is above comes to. One row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    if weights is None:
        weighed = by_source.withColumn("weight", F.pmod(place - 1, F.lit(3)) + 1)
    else:
        given = F.lit(0)
        for name, weight in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(weight)).otherwise(given)
        weighed = by_source.withColumn("weight", given)
    order = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    backwards = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).desc(), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leveled = (
        weighed.where("weight > 0")
        .withColumn("limit", F.lit(most) * F.col("source_size"))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(backwards))
        .withColumn("level", (F.lit(total) * F.col("all") - F.col("used")) / F.col("left"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    level = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(TOKEN)), F.lit(0)).cast("bigint")


def rank_of(key: Column, size: Column, seed: int) -> Column:
    """The odds of the key's number over those of the inclusion; null for what is never drawn."""
    u = uniform(key, seed)
    return F.when((size > 0) & (F.col("need") > 0), (u / (1 - u)) / (F.col("fraction") / (1 - F.col("fraction"))))


def bin_of(rank: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(rank / (1 + rank) * BINS)).cast("int")


def decisions(sizes: DataFrame, total: float, most: int, weights: dict[str | None, int] | None, seed: int) -> DataFrame:
    """One row for each source: what its documents are drawn by, the last place (rank, id, size) of those drawn, and the one drawn besides.

    Equal rows share a place: they are drawn together or not at all.
    """
    plan = targets(sizes, total, most, weights).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("ratio")).withColumn("fraction", F.col("ratio") - F.col("whole"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "fraction", "need"), "plan")
    joined = sizes.join(small(plan), F.col("source").eqNullSafe(F.col("of"))).where("size > 0 and need > 0")
    ranked = joined.select("of", "need", "id", "size", rank_of(F.col("id"), F.col("size"), seed).alias("rank"))
    ranked = written(ranked.withColumn("bin", bin_of(F.col("rank"))), "ranked")

    bins = ranked.groupBy("of", "bin", "need").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("of").orderBy("bin"))).withColumn("before", F.col("upto") - F.col("words"))
    edge = written(bins.where("before <= need and upto > need").select(F.col("of").alias("source"), F.col("bin").alias("edge"), "before"), "edge")

    same = F.col("of").eqNullSafe(F.col("source"))
    met = ranked.join(small(edge), same, "left").drop("source")
    reached = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("rank", "id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    within = met.where("bin = edge").withColumn("reached", reached).where("reached <= need")
    cut = within.groupBy("of").agg(F.max(F.struct("rank", "id", "size")).alias("cut"), F.max("reached").alias("met"))
    edge = written(edge.join(cut, same, "left").drop("of"), "cut")

    met = ranked.join(small(edge), same).drop("source")
    left = met.where(F.when(F.col("bin") == F.col("edge"), F.coalesce(F.struct("rank", "id", "size") > F.col("cut"), F.lit(True))).otherwise(F.col("bin") > F.col("edge")))
    left = left.withColumn("gap", F.col("need") - F.coalesce("met", "before"))
    last = left.groupBy("of", "gap").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "id", "size")).alias("x"))
    last = last.where("x.off < gap").select(F.col("of").alias("source"), F.struct("x.rank", "x.id", "x.size").alias("last"))
    edge = edge.select(F.col("source").alias("at"), "edge", "cut").join(last, F.col("at").eqNullSafe(F.col("source")), "left").drop("source")
    return written(plan.join(edge, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "decisions")


def small(df: DataFrame) -> DataFrame:
    """A written table with a row for each source: broadcast if it has at most ``SOURCES`` rows, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SOURCES else df


def decided(key: Column, size: Column, seed: int) -> Column:
    """The copies of a row that was joined to the decisions of its source."""
    rank = rank_of(key, size, seed)
    place = F.struct(rank.alias("rank"), key.alias("id"), size.alias("size"))
    drawn = F.when(F.col("edge").isNull(), True).when(bin_of(rank) != F.col("edge"), bin_of(rank) < F.col("edge"))
    drawn = drawn.otherwise(F.coalesce(place <= F.col("cut"), F.lit(False))) | place.eqNullSafe(F.col("last"))
    return (F.col("whole") + F.when(rank.isNotNull() & drawn, 1).otherwise(0)).cast("bigint")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    total: float = 1.0,
    most: int = 3,
    weights: dict[str | None, int] | None = None,
    seed: int = 9,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    Null texts have size 0; null sources are one source, the last; documents of size 0 are copied as the whole part says, and never
    drawn. Rows of equal id draw equal numbers and are told apart by size; equal rows get the same copies. Reruns agree.
    A table without a source column is one source. Further columns are ignored; an empty table gives an empty result.
    """
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), column_or_null(docs, source_col, "string").alias("source"), size_of(text_col).alias("size"))
    sizes = written(sizes, "sizes")
    plan = decisions(sizes, total, most, weights, seed)
    joined = sizes.join(small(plan), F.col("source").eqNullSafe(F.col("of")))
    copies = decided(F.col("id"), F.col("size"), seed)
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    total: float = 1.0,
    most: int = 3,
    weights: dict[str | None, int] | None = None,
    seed: int = 9,
) -> DataFrame:
    """The mixture itself: each input row as often as its copies say, with its own columns only.

    Only the decisions of the sources meet the rows, so texts are shuffled only where the sources are too many to broadcast.
    """
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), column_or_null(docs, source_col, "string").alias("source"), size_of(text_col).alias("size"))
    plan = decisions(written(sizes, "sizes"), total, most, weights, seed)
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{id_col}`").alias("id"), column_or_null(docs, source_col, "string").alias("source"), size_of(text_col).alias("size"))
    joined = held.join(small(plan), F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn(copy, decided(F.col("id"), F.col("size"), seed)).where(F.col(copy) > 0)
    return joined.select(row, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int"))).alias(copy)).select(f"{row}.*")


#: The same mixture in DuckDB, with one plain sort of each source.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source
), leveled AS (
  SELECT *, 3 * source_size AS lim, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER
    (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST) AS place
  FROM weighed
), chosen AS (
  SELECT level FROM leveled WHERE level * weight <= lim ORDER BY place LIMIT 1
), plan AS (
  SELECT source, source_size, least(CAST(lim AS DOUBLE), coalesce((SELECT level FROM chosen) * weight, CAST(lim AS DOUBLE))) AS target
  FROM leveled
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS fraction
  FROM plan
), drawn AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    CASE WHEN s.size > 0 AND p.target - p.whole * p.source_size > 0
      THEN (u / (1 - u)) / (p.fraction / (1 - p.fraction)) END AS rank
  FROM (SELECT *, (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':9'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM sizes) s
  JOIN split p ON s.source IS NOT DISTINCT FROM p.source
), reached AS (
  SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size RANGE UNBOUNDED PRECEDING) <= need AS taken_in FROM drawn
), gaps AS (
  SELECT source, any_value(need) - coalesce(sum(size) FILTER (taken_in), 0) AS gap FROM reached GROUP BY source
), ends AS (
  SELECT r.*, abs(g.gap - size) < g.gap AND row_number() OVER (PARTITION BY r.source, taken_in OR rank IS NULL ORDER BY abs(g.gap - size), rank, doc_id, size) = 1
    AND NOT taken_in AND rank IS NOT NULL AS last
  FROM reached r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken_in OR last THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ends
"""
