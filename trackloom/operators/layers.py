"""Which tables of a project a query reads: roles by columns, names, visibility, selection, class filters, and the table of a mode.

A layers table has one row for each table: project, layer_id, place (order of adding), name, source, columns (array of names), and where they matter
subset (its filter text), categories (array of (value, enabled)), visible, selected (array of row ids), memory (made in this session).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_candidate_name, is_marking_mode

#: Columns by which roles are told, and names of marking tables (a project with names of its own passes these as ``marks``).
CANDIDATE_COLUMNS = ("semantic_class", "candidate_id", "evidence_face", "detection_id")
MARKING_MARKS = ("360 markings", "360 click targets", "markings_360", "click_targets_360")
#: Fixed names of the columns that marking tables have.
MARKING_COLUMNS = {
    "video": "string", "frame": "bigint", "target_id": "bigint", "target_order": "bigint", "x_ratio": "double", "y_ratio": "double", "yaw_delta": "double", "target_yaw": "double", "target_pitch": "double",
    "view_yaw": "double", "view_pitch": "double", "view_zoom": "double", "created_at": "string",
}


def has_column(columns: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(columns, name), F.lit(False))


def text_of(name: Column, source: Column) -> Column:
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.coalesce(source, F.lit(""))))


def with_roles(layers: DataFrame, marks: tuple[str, ...] = MARKING_MARKS) -> DataFrame:
    """Adds is_frame, is_marking, is_candidate, is_all_classes, is_named_marking, is_named_candidate.

    A candidate table may have the columns of a marking table too; then it isn't read as markings.
    """
    c = F.col("columns")
    candidate = has_column(c, "frame") & has_column(c, "target_yaw") & has_column(c, "target_pitch") & F.exists(F.array(*[has_column(c, n) for n in CANDIDATE_COLUMNS]), lambda x: x)
    marking = has_column(c, "frame") & has_column(c, "target_id")
    text = text_of(F.col("name"), F.col("source"))
    return layers.withColumns(
        {
            "is_frame": has_column(c, "frame") & ~has_column(c, "target_id"),
            "is_marking": marking,
            "is_candidate": candidate,
            "is_all_classes": candidate & text.contains("all_classes"),
            "is_named_marking": marking & ~candidate & text.rlike("|".join(marks)),
            "is_named_candidate": candidate & is_candidate_name(text),
        }
    )


def is_visible(visible: Column) -> Column:
    """A table that the tree doesn't know counts as visible."""
    return F.coalesce(visible, F.lit(True))


#: A condition of a filter text on the class: the column's name, an operator, and the quoted texts after it.
QUOTED = r"""(?:'[^'"]+'|"[^'"]+")"""
CONDITION = rf"""(?i)semantic_class\s*(=|like\b|in\b)\s*\(?\s*({QUOTED}(?:\s*,\s*{QUOTED})*)"""


def subset_classes(subset: Column) -> Column:
    """The class names of a filter text, sorted: of its first equation, else of its first LIKE, else of its first list, whichever names any first."""
    operators, texts = (F.regexp_extract_all(subset, F.lit(CONDITION), F.lit(k)) for k in (1, 2))
    conditions = F.zip_with(operators, texts, lambda o, t: F.struct(F.lower(o).alias("operator"), F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)).alias("texts")))
    inner = lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2))

    def named(operator: str) -> Column:
        first = F.get(F.filter(conditions, lambda c: c["operator"] == operator), F.lit(0))["texts"]
        return F.filter(F.transform(first if operator == "in" else F.slice(first, 1, 1), inner), lambda x: x != "")

    none = F.array().cast("array<string>")
    found = F.filter(F.array(*[F.coalesce(named(o), none) for o in ("=", "like", "in")]), lambda names: F.size(names) > 0)
    return F.sort_array(F.array_distinct(F.coalesce(F.get(found, F.lit(0)), none)))


def active_classes(subset: Column, categories: Column) -> Column:
    """The classes of the filter text and, where only some categories are enabled, the enabled ones, sorted; all_classes and blanks don't count."""
    named = F.filter(F.transform(F.filter(categories, lambda c: F.coalesce(c["enabled"], F.lit(True))), lambda c: F.trim(F.coalesce(c["value"], F.lit("")))), lambda v: (v != "") & (F.lower(v) != "all_classes"))
    enabled = F.when((F.size(named) > 0) & (F.size(named) < F.size(categories)), named)
    return F.sort_array(F.array_union(subset_classes(subset), F.coalesce(enabled, F.array().cast("array<string>"))))


def candidate_layers(layers: DataFrame, visible_only: bool = False) -> DataFrame:
    """The candidate tables of each project with ``turn`` from 1: this session's own latest one first, then the latest added first; each once."""
    rows = with_roles(layers).where("is_candidate")
    if visible_only:
        rows = rows.where(is_visible(F.col("visible")))
    by_place = Window.partitionBy("project", "layer_id").orderBy(F.col("place").desc())
    rows = rows.withColumn("__again", F.row_number().over(by_place)).where("__again = 1").drop("__again")
    memory = F.coalesce(F.col("memory"), F.lit(False))
    own = F.max(F.when(memory, F.col("place"))).over(Window.partitionBy("project"))
    turn = F.row_number().over(Window.partitionBy("project").orderBy(F.coalesce(F.col("place") == own, F.lit(False)).desc(), F.col("place").desc()))
    return rows.withColumn("turn", turn)


def marking_layers(layers: DataFrame, marks: tuple[str, ...] = MARKING_MARKS) -> DataFrame:
    """The marking tables of each project that are read, with ``turn`` from 1: this session's own latest one first, then named ones, the latest first."""
    rows = with_roles(layers, marks).where("is_marking and not is_candidate")
    memory = F.coalesce(F.col("memory"), F.lit(False))
    own = F.max(F.when(memory, F.col("place"))).over(Window.partitionBy("project"))
    rows = rows.withColumn("__own", F.coalesce(F.col("place") == own, F.lit(False))).where("__own or is_named_marking")
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("__own"), F.desc("place")))).drop("__own")


def in_scope(layers: DataFrame, rows: DataFrame, scope: str, active: str = "active") -> DataFrame:
    """The candidate rows (project, layer_id, row_id, ...) that a scope reads: active, visible, all or selected, with their table's ``turn``.

    active: the column that marks a project's active table. Without a selection ``selected`` reads nothing.
    """
    read = candidate_layers(layers, visible_only=scope == "visible")
    if scope == "active":
        read = read.where(F.coalesce(F.col(active), F.lit(False)))
    # merged: a list of tables may be long, and its file tells little of how large the rows made from it are
    found = rows.join(read.select("project", "layer_id", "turn", "selected").hint("merge"), ["project", "layer_id"])
    if scope == "selected":
        found = found.where(F.coalesce(F.array_contains("selected", F.col("row_id")), F.lit(False)))
    return found.drop("selected")


def preferred_layer(asked: DataFrame, layers: DataFrame) -> DataFrame:
    """asked (project, mode) with layer_id: the table that a mode navigates.

    Frames: this session's own latest frame table, else the active one. Markings: the first that is read. Detections: the first with a selection, the first with a
    filter, the active one, one of all classes, the first. Null where there is none.
    """
    roles = with_roles(layers)
    memory, active = (F.coalesce(F.col(n), F.lit(False)) for n in ("memory", "active"))
    frame = roles.where(F.col("is_frame") & (memory | active)).select("project", F.lit("frame").alias("kind"), "layer_id", F.struct((~memory).alias("a"), (-F.col("place")).alias("b")).alias("order"))
    marks = marking_layers(layers).select("project", F.lit("marking").alias("kind"), "layer_id", F.struct(F.lit(False).alias("a"), F.col("turn").cast("bigint").alias("b")).alias("order"))
    rank = F.when(F.coalesce(F.size("selected"), F.lit(0)) > 0, 0).when(F.coalesce(F.trim("subset"), F.lit("")) != "", 1).when(active, 2).when(F.col("is_all_classes"), 3).otherwise(4)
    found = candidate_layers(layers).select("project", F.lit("detect").alias("kind"), "layer_id", F.struct(F.lit(False).alias("a"), (rank * 1_000_000 + F.col("turn")).cast("bigint").alias("b")).alias("order"))
    best = frame.unionByName(marks).unionByName(found).groupBy("project", "kind").agg(F.min_by("layer_id", "order").alias("layer_id"))
    mode = F.lower(F.trim("mode"))
    kind = F.when(mode.isin("frame", "layer", "kp"), "frame").when(is_marking_mode(F.col("mode")), "marking").when(mode == "detect", "detect")
    return asked.withColumn("kind", kind).join(best, ["project", "kind"], "left").select(*asked.columns, "layer_id")


def model_names(rows: DataFrame, key: str = "project", most: int = 2) -> DataFrame:
    """key, names: up to two different names in the tables' model_name, in the order of the tables' ``turn`` and of their rows."""
    named = rows.select(key, F.trim("model_name").alias("name"), "turn", "pos").where("name <> ''")
    first = named.groupBy(key, "name").agg(F.min(F.struct("turn", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    kept = first.withColumn("n", place).where(F.col("n") <= most)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list("name")).alias("names"))


def backup_name(name: Column, columns: Column, single_class: Column, base: Column, index: Column, safe, markings: str = MARKING_MARKS[2]) -> Column:
    """The name a table is saved under, by its role: ``safe`` makes a table name of a text."""
    candidate = has_column(columns, "frame") & has_column(columns, "target_yaw") & has_column(columns, "target_pitch") & F.exists(F.array(*[has_column(columns, n) for n in CANDIDATE_COLUMNS]), lambda x: x)
    tail = F.regexp_extract(F.coalesce(name, F.lit("")), "(?s)^(?:360 Detection Candidates: |360 POI Clusters: |POI: )(.*)$", 1)
    prefixed = F.coalesce(name, F.lit("")).rlike("^(360 Detection Candidates: |360 POI Clusters: |POI: )")
    found = F.when(F.coalesce(single_class, F.lit("")) != "", safe(F.concat(F.lit("poi_clusters_"), single_class))).when(prefixed, safe(tail)).when(name.rlike("^poi_(candidates|clusters)"), safe(name)).otherwise("poi_candidates_360")
    plain = safe(F.format_string("%s_%02d", base, index))
    return F.when(columns.isNull(), plain).when(candidate, found).when(has_column(columns, "target_id"), markings).when(has_column(columns, "frame"), "video_gpx_points").otherwise(plain)


def migrated(rows: DataFrame, columns: dict[str, str] = MARKING_COLUMNS) -> DataFrame:
    """The table with the marking columns it lacks, as nulls; its own columns stay as they are."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({n: F.lit(None).cast(k) for n, k in columns.items() if n not in have})


def without_row_ids(rows: DataFrame) -> DataFrame:
    """The table without the row numbers that a file format adds, in any case of letters."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("fid", "ogc_fid")])


def safe_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The columns asked for in their kinds; one that is missing, or a value that doesn't read, is null."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[n.lower()]}`").try_cast(k) if n.lower() in have else F.lit(None).cast(k)).alias(n) for n, k in wanted.items()])


def hidden(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The same table; columns of these names carry ``hidden`` in their metadata."""
    for c in rows.columns:
        if c in names:
            rows = rows.withMetadata(c, {"hidden": True})
    return rows


def filtered(rows: DataFrame, subset: str | None) -> DataFrame:
    """The rows that a table's own filter text lets through; all of them if it is blank or can't be read over these columns."""
    if not (subset or "").strip():
        return rows
    try:
        return rows.where(subset)
    except (AnalysisException, ParseException):
        return rows


def changed(loaded: DataFrame, now: DataFrame) -> DataFrame:
    """The tables to save: made since loading, edited, or with another number of rows than then.

    loaded: (layer_id, features); now: (layer_id, features, edited).
    """
    before = loaded.select(F.col("layer_id").alias("__id"), F.col("features").alias("__features")).hint("merge")
    both = now.join(before, F.col("layer_id") == F.col("__id"), "left")
    return both.where(F.col("__id").isNull() | F.coalesce("edited", F.lit(False)) | ~F.col("features").eqNullSafe(F.col("__features"))).drop("__id", "__features")
