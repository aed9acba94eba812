"""Settings records and anchor layouts.

A settings record is JSON text.  Scalars are cast and clamped; one that cannot
be cast voids the record, which then takes every default.  Layout coordinates
count only in records of the current version, and an anchor with the wrong
number of coordinates keeps its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack import schemas
from tagtrack.functions.geometry import clamp

_NUMBER_TEXT = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _part(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _kind(value: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)


def _number(value: Column, whole: bool) -> Column:
    """Numeric value of a JSON scalar, NULL when it cannot be cast."""
    kind = _kind(value)
    text = F.try_variant_get(value, "$", "string")
    as_double = F.try_variant_get(value, "$", "double")
    number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), as_double).when(
        (kind == "STRING") & text.rlike(_INT_TEXT if whole else _NUMBER_TEXT), F.btrim(text).try_cast("double")
    )
    if whole:
        # truncation toward zero
        return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")
    return number


def _scalar(doc: Column, name: str, default: float, whole: bool) -> tuple[Column, Column]:
    """(value or default when absent, whether the record is void because of it)."""
    found = _part(doc, f"$.{name}")
    value = _number(found, whole)
    return F.when(found.isNull(), F.lit(float(default))).otherwise(value), found.isNotNull() & value.isNull()


def _layout_entries(doc: Column, mode: str) -> Column:
    """One struct per default anchor: the document's coordinates where they are usable.

    ``bad`` marks a list of the right length with a coordinate that is no number.
    """
    axes = 3 if mode == "3d" else 2
    defaults = F.array(
        *[
            F.struct(
                F.lit(layout_id).alias("layout_id"),
                F.lit(name).alias("layout_name"),
                F.lit(anchor_id).alias("anchor_id"),
                F.array(*[F.lit(v) for v in spot]).alias("spot"),
            )
            for layout_id, (name, anchors) in K.LAYOUTS[mode].items()
            for anchor_id, spot in anchors.items()
        ]
    )
    layouts = F.try_variant_get(doc, "$.layouts", "map<string,variant>")

    def entry(d: Column) -> Column:
        layout = F.try_element_at(layouts, d["layout_id"].cast("string"))
        anchors = F.try_variant_get(layout, "$.anchors", "map<string,variant>")
        got = F.try_element_at(anchors, d["anchor_id"].cast("string"))
        parts = F.when(_kind(got) == "ARRAY", F.try_variant_get(got, "$", "array<variant>"))
        sized = F.coalesce(F.size(parts) == axes, F.lit(False))
        coords = F.transform(parts, lambda p: _number(p, False))
        return F.struct(
            d["layout_id"].alias("layout_id"),
            d["anchor_id"].alias("anchor_id"),
            d["layout_name"].alias("default_name"),
            d["spot"].alias("default_spot"),
            F.coalesce(F.try_variant_get(layout, "$.name", "string"), d["layout_name"]).alias("layout_name"),
            F.when(sized, coords).otherwise(d["spot"]).alias("spot"),
            (sized & F.exists(coords, lambda c: c.isNull())).alias("bad"),
        )

    return F.transform(defaults, entry)


def _read(records: DataFrame, mode: str, raw: str) -> DataFrame:
    """Add the parsed scalars, layout entries and whether the document stands."""
    doc = F.col("_doc")
    version, void = _scalar(doc, "settings_version", 0, True)
    values = {}
    for name, (default, _, _) in K.SETTINGS[mode].items():
        values[name], bad = _scalar(doc, name, default, isinstance(default, int))
        void = void | bad
    read = records.withColumn("_doc", F.try_parse_json(F.col(raw))).select(
        "*",
        *[v.alias(f"_v_{n}") for n, v in values.items()],
        F.coalesce(_kind(doc) == "OBJECT", F.lit(False)).alias("_object"),
        void.alias("_void"),
        (version == K.SETTINGS_VERSION).alias("_current"),
        _layout_entries(doc, mode).alias("_entries"),
    )
    spoilt = F.col("_current") & F.exists("_entries", lambda e: e["bad"])
    stands = F.col("_object") & ~F.col("_void") & ~F.coalesce(spoilt, F.lit(False))
    return read.withColumn("_ok", stands).withColumn("layouts_apply", F.coalesce(stands & F.col("_current"), F.lit(False)))


def sanitize(records: DataFrame, mode: str = "2d", raw: str = "raw") -> DataFrame:
    """Replace the JSON column by clamped settings columns and ``layouts_apply``."""
    out = []
    for name, (default, lo, hi) in K.SETTINGS[mode].items():
        v = F.col(f"_v_{name}")
        if lo is not None:
            v = clamp(v, float(lo), float(hi))
        v = F.when(F.col("_ok"), v).otherwise(F.lit(float(default)))
        out.append(v.cast("int" if isinstance(default, int) else "double").alias(name))
    keep = [c for c in records.columns if c != raw]
    return _read(records, mode, raw).select(*keep, *out, "layouts_apply")


def layout_rows(records: DataFrame, mode: str = "2d", raw: str = "raw") -> DataFrame:
    """Anchor rows of every layout of every document, with defaults where they apply."""
    keep = [c for c in records.columns if c != raw]
    rows = _read(records, mode, raw).select(*keep, "layouts_apply", F.explode("_entries").alias("_e"))
    own = F.col("layouts_apply")
    spot = F.when(own, F.col("_e.spot")).otherwise(F.col("_e.default_spot"))
    return rows.select(
        *keep,
        "_e.layout_id",
        F.when(own, F.col("_e.layout_name")).otherwise(F.col("_e.default_name")).alias("layout_name"),
        "_e.anchor_id",
        *[F.get(spot, F.lit(i)).alias(n) for i, n in enumerate(("ax", "ay", "az"))],
    )


def read_settings(spark: SparkSession, path: str, mode: str = "2d") -> DataFrame:
    """Settings files (one JSON document each) as one clamped row per file."""
    docs = spark.read.option("wholetext", True).text(path)
    return sanitize(docs.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")), mode)


def anchor_table(spark: SparkSession, mode: str = "2d") -> DataFrame:
    """The default layouts as rows; 20 rows whatever the data size."""
    rows = [
        (layout_id, name, anchor_id, *(list(spot) + [None])[:3])
        for layout_id, (name, anchors) in K.LAYOUTS[mode].items()
        for anchor_id, spot in anchors.items()
    ]
    return spark.createDataFrame(rows, schemas.ANCHORS)


def active_anchor_count(count: Column) -> Column:
    return clamp(count, 2, 6)
