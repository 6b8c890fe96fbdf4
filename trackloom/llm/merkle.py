"""A Merkle manifest of a dataset by checkpoint and recompute. DataFrame functions only.

Each row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a source, in ascending order of
the key, are one tree: every ``arity`` consecutive nodes become the digest of their concatenated hex digests, until one node, the subroot, remains. The
subroots, in order of their sources (null first, by UTF-8 bytes), are the leaves of one more tree, whose last node is the root.

Only every ``every``-th level is persisted, as aligned subtrees: a row holds the up to ``arity ** every`` stored nodes under one node of the next
persisted level. A proof needs nodes of all levels; those between are regenerated for each aligned subtree from its stored
nodes, their siblings are emitted, and they are discarded with the row. Proofs grow from the root downwards: a subtree's row meets the proof of
the node above it, and each stored node gets its own siblings in front of that, so what is joined is one row for each subtree.

No source is gathered: rows get their places by ``tables.ranked``, and a task holds a subtree of bounded size at a time, whatever the size of
the source. A folder of a manifest has ``leaves-0``, ``leaves-1``, ... (persisted levels of the sources' trees), ``top-0``, ... (those of the sources' own tree), ``sources`` and ``facts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ranked, written

ARITY, EVERY = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: of all its fields in turn, told apart by their lengths and by ``-`` where null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return hashed(F.concat(*parts))


def above(nodes: Column, arity: int) -> Column:
    """The level above an array of consecutive nodes that starts at an aligned place."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(arity))
    return F.transform(starts, lambda k: hashed(F.array_join(F.slice(nodes, k, arity), "")))


def levels(nodes: Column, rounds: Column, arity: int) -> Column:
    """The stored nodes of a subtree, and every level above them up to and with its top."""
    grown = F.aggregate(F.sequence(F.lit(1), rounds), F.array(nodes), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1), arity))))
    return F.when(rounds > 0, grown).otherwise(F.array(nodes))


def siblings(grown: Column, place: Column, arity: int) -> Column:
    """For each level from a stored node up to below the top: the digests of its run before and after its own, each concatenated."""

    def of(level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(arity), level)).cast("int")
        nodes, start = F.element_at(grown, level + 1), own - own % arity
        before = F.array_join(F.slice(nodes, start + 1, own - start), "")
        after = F.array_join(F.slice(nodes, own + 2, F.lit(arity - 1) - (own - start)), "")
        return F.struct(before.alias("before"), after.alias("after"))

    none = F.array().cast("array<struct<before:string,after:string>>")
    return F.when(F.size(grown) > 1, F.transform(F.sequence(F.lit(0), F.size(grown) - 2), of)).otherwise(none)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda acc, level: hashed(F.concat(level["before"], acc, level["after"])))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level upwards and from left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def height(count: Column, arity: int) -> Column:
    """Rounds until one of so many nodes remains, by whole numbers."""
    steps = F.lit(0)
    power = 1
    while power < 1 << 62:
        steps = steps + (count > F.lit(power)).cast("int")
        power *= arity
    return steps


@dataclass
class Manifest:
    """A manifest's folder and the few numbers that its readers need."""

    spark: SparkSession
    folder: str
    arity: int
    every: int
    levels: dict[str, int]

    def level(self, name: str, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}-{k}")

    @property
    def sources(self) -> DataFrame:
        """(source, tree, leaves, height, subroot), a row for each source."""
        return self.spark.read.parquet(f"{self.folder}/sources")

    @property
    def root(self) -> str | None:
        """The digest of the whole dataset; null if it has no rows."""
        return self.spark.read.parquet(f"{self.folder}/facts").first()["root"]


def grow(rows: DataFrame, counts: DataFrame, folder: str, name: str, arity: int, every: int) -> tuple[DataFrame, int]:
    """Persists the trees of (tree, place, digest, held) rows; (tree, subroot) rows and the number of persisted levels.

    A level's rows are (tree, block, rounds, nodes): the aligned subtrees, ``rounds`` levels below their tops. counts: (tree, height).
    """
    spark, tops, k = rows.sparkSession, None, 0
    deepest = counts.agg(F.max("height")).first()[0] or 0
    width = arity**every
    while True:
        subtree = rows.groupBy("tree", F.floor(F.col("place") / width).cast("bigint").alias("block"))
        gathered = subtree.agg(F.array_sort(F.collect_list(F.struct(F.pmod("place", F.lit(width)).cast("int").alias("at"), "digest", "held"))).alias("nodes"))
        rounds = F.greatest(F.lit(0), F.least(F.lit(every), F.col("height") - every * k))
        gathered.join(counts, "tree").select("tree", "block", rounds.alias("rounds"), "nodes").write.parquet(f"{folder}/{name}-{k}")
        stored = spark.read.parquet(f"{folder}/{name}-{k}")
        topmost = F.element_at(levels(F.col("nodes.digest"), F.col("rounds"), arity), -1)[0]
        made = written(stored.select("tree", F.col("block").alias("place"), topmost.alias("digest")), f"{name}-tops")
        ended = made.join(counts, "tree").where((F.col("height") <= every * (k + 1)) & ((F.col("height") > every * k) | F.lit(k == 0))).select("tree", F.col("digest").alias("subroot"))
        tops = ended if tops is None else tops.union(ended)
        k += 1
        if deepest <= every * k:
            return tops, k
        going = made.join(counts, "tree").where(F.col("height") > every * k)
        rows = going.select("tree", "place", "digest", F.lit(None).cast("tinyint").alias("held"))


def write_manifest(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    *,
    held: dict[str, Column] | None = None,
    arity: int = ARITY,
    every: int = EVERY,
) -> Manifest:
    """Writes the manifest of all rows of a table into a new folder.

    Leaves ascend by key, null keys first, then by digest, so that equal rows stand side by side; repeated rows are leaves of their own, and null sources are one source, the
    first. Null fields count as such, texts are hashed whole, and columns that aren't named don't matter. An empty table has no sources and a null root.
    ``held``: further columns, computed where the row is read and kept beside its leaf.
    """
    if every < 1 or arity < 2:
        raise ValueError("a tree has two children a node at least, and a persisted level after one at least")
    spark, key = docs.sparkSession, F.col(f"`{id_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # n: no source, before all others
    kept = F.struct(key.alias("id"), *[c.alias(n) for n, c in (held or {}).items()]).alias("held")
    leaves = docs.select(tree.alias("tree"), leaf(*[F.col(f"`{f}`") for f in fields]).alias("digest"), kept)
    placed = ranked(leaves, [F.col("held.id").asc_nulls_first(), F.col("digest")], ["tree"])
    counts = placed.groupBy("tree").agg(F.count("*").alias("leaves"))
    counts = written(counts.withColumn("height", height(F.col("leaves"), arity)), "counts")
    tops, below = grow(placed, counts.select("tree", "height"), folder, "leaves", arity, every)
    named = counts.join(tops, "tree").select(F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30)).alias("source"), "tree", "leaves", "height", "subroot")
    named.write.parquet(f"{folder}/sources")
    sources = spark.read.parquet(f"{folder}/sources")

    whole = F.lit("").alias("tree")
    tips = ranked(sources.select(whole, F.col("subroot").alias("digest"), F.struct("tree", "height").alias("held")), [F.col("held.tree")])
    count = written(sources.agg(F.count("*").alias("n")).select(whole, height(F.col("n"), arity).alias("height")), "count")
    ends, over = grow(tips, count, folder, "top", arity, every)
    facts = ends.select("tree", F.col("subroot").alias("root"), F.lit(arity).alias("arity"), F.lit(every).alias("every"), F.lit(below).alias("leaf_levels"), F.lit(over).alias("top_levels"))
    if sources.isEmpty():
        facts = count.select("tree", F.lit(None).cast("string").alias("root"), F.lit(arity).alias("arity"), F.lit(every).alias("every"), F.lit(below).alias("leaf_levels"), F.lit(over).alias("top_levels"))
    facts.write.parquet(f"{folder}/facts")
    return Manifest(spark, folder, arity, every, {"leaves": below, "top": over})


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    facts = spark.read.parquet(f"{folder}/facts").first()
    return Manifest(spark, folder, facts["arity"], facts["every"], {"leaves": facts["leaf_levels"], "top": facts["top_levels"]})


def descend(manifest: Manifest, name: str, starts: DataFrame) -> DataFrame:
    """(tree, held, digest, proof, subroot) of all leaves of the trees.

    starts: (tree, levels, proof, subroot), what follows above each tree, on how many levels it is stored, and its top.
    """
    found, arity = None, manifest.arity
    for k in reversed(range(manifest.levels[name])):
        over = starts.where(F.col("levels") == k + 1).select("tree", F.lit(0).cast("bigint").alias("block"), F.col("proof").alias("rest"), "subroot")
        if found is not None:
            over = over.unionByName(found.select("tree", F.col("place").alias("block"), F.col("proof").alias("rest"), "subroot"))
        met = manifest.level(name, k).join(over, ["tree", "block"]).withColumn("grown", levels(F.col("nodes.digest"), F.col("rounds"), arity))

        def own(node: Column) -> Column:
            proof = F.concat(siblings(F.col("grown"), node["at"], arity), F.col("rest"))
            return F.struct(node["at"].alias("at"), node["digest"].alias("digest"), node["held"].alias("held"), proof.alias("proof"))

        each = met.select("tree", "block", "subroot", F.explode(F.transform("nodes", own)).alias("x"))
        found = each.select("tree", (F.col("block") * arity**manifest.every + F.col("x.at")).alias("place"), "x.digest", "x.held", "x.proof", "subroot")
    return found


def stored_levels(height: Column, every: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(height / F.lit(every))).cast("int")


def proofs(manifest: Manifest) -> DataFrame:
    """A row for each leaf: tree, place, digest, held, proof (from the leaf to the root: the digests before and after its own on each level), subroot."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    facts = manifest.spark.read.parquet(f"{manifest.folder}/facts")
    top = facts.select("tree", F.col("top_levels").alias("levels"), none.alias("proof"), F.col("root").alias("subroot"))
    tips = descend(manifest, "top", top)
    starts = tips.select("held.tree", stored_levels(F.col("held.height"), manifest.every).alias("levels"), "proof", F.col("digest").alias("subroot"))
    return descend(manifest, "leaves", written(starts, "starts"))


def tampered_leaf(fields: tuple[str, ...] = FIELDS, text_col: str = "text", id_col: str = "doc_id") -> Column:
    """What the leaf of a row would be without the line feeds of its text, for the even half of the keys by CRC-32; else null."""
    cut = [F.translate(F.col(f"`{f}`").cast("string"), "\n", "") if f == text_col else F.col(f"`{f}`") for f in fields]
    return F.when(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0, leaf(*cut))


def proved(manifest: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, and folded_root and verified of the digest held as ``claimed``, of the leaf itself where that is null."""
    claimed = folded(F.coalesce("held.claimed", "digest"), F.col("proof"))
    rows = proofs(manifest).select(
        F.col("held.id").alias("id"), F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), hashed(proof_text(F.col("proof"))).alias("proof_sha256"), claimed.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same proofs in DuckDB, with every node of every level. CRC-32 by its table of 256 entries, made by the rule of the polynomial.
MANIFEST_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), given AS (
  SELECT *, coalesce('s' || source, 'n') AS tree, doc_id IS NOT NULL AND list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
    lambda c, b: xor(t[1 + CAST(xor(c, b) & 255 AS INT)], c // 256)) % 2 = 1 AS even FROM documents, crc
), said AS (
  SELECT doc_id, tree, even, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM given
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN even THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS claimed FROM said)
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3, n
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM subroots
  UNION ALL SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3, n
), below AS (
  SELECT l.tree, l.place, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < l.place // (3 ** x.level)::BIGINT), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > l.place // (3 ** x.level)::BIGINT), '') AS after
  FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.place // 3 = l.place // (3 ** (x.level + 1))::BIGINT GROUP BY ALL
), over AS (
  SELECT s.tree, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < s.place // (3 ** x.level)::BIGINT), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > s.place // (3 ** x.level)::BIGINT), '') AS after
  FROM subroots s JOIN tops x ON x.n > 1 AND x.place // 3 = s.place // (3 ** (x.level + 1))::BIGINT GROUP BY s.tree, s.place, x.level
), steps AS (
  SELECT tree, place, row_number() OVER (PARTITION BY tree, place ORDER BY part, level) AS step, before, after FROM (
    SELECT tree, place, 0 AS part, level, before, after FROM below
    UNION ALL SELECT l.tree, l.place, 1, o.level, o.before, o.after FROM leaves l JOIN over o ON o.tree = l.tree)
), folds AS (
  SELECT tree, place, CAST(0 AS BIGINT) AS step, coalesce(claimed, leaf) AS digest FROM leaves
  UNION ALL SELECT f.tree, f.place, s.step, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.step = f.step + 1
), ended AS (
  SELECT tree, place, arg_max(digest, step) AS folded_root FROM folds GROUP BY ALL
), texts AS (
  SELECT tree, place, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY ALL
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(coalesce(t.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ended e ON e.tree = l.tree AND e.place = l.place LEFT JOIN texts t ON t.tree = l.tree AND t.place = l.place, (SELECT digest FROM tops WHERE n = 1) r
"""
