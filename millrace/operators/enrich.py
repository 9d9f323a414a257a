"""Enrichment: registry lookup, code decoding, precedence merge, land use and reprocessing plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feature_centre, first_truthy, haversine, lenient_number, well_number
from .records import let

#: Codes of the registry and what they mean.
DATUMS = {"K": "Kelly Bushing", "G": "Ground", "R": "Rotary Table", "D": "Drill Floor"}
SLANTS = {"H": "Horizontal", "D": "Deviated", "V": "Straight"}
WELL_TYPES = {
    "GAS": "Gas Production", "DH": "Dry Hole", "MTW": "Mineral", "MNB": "Mineral", "BDW": "Brine Disposal", "OIL": "Oil Production",
    "LOC": "Location", "LPG": "LPG", "MSM": "Min", "WIW": "Water Injection", "GSO": "Gas Storage", "MDW": "Mineral", "GS": "Gas Storage",
    "GIW": "Gas Injection", "LHL": "Lost Hole", "OTH": "Other", "OBS": "Observation",
}
#: Land-use classes by tag value.
LAND_USE = {
    "residential": "Residential", "commercial": "Commercial", "retail": "Commercial", "industrial": "Industrial", "railway": "Transportation",
    "road": "Transportation", "construction": "Industrial", "farmland": "Agricultural", "farmyard": "Agricultural", "orchard": "Agricultural",
    "vineyard": "Agricultural", "forest": "Forest", "meadow": "Agricultural", "grass": "Public/Open", "cemetery": "Public/Open",
    "recreation_ground": "Public/Open", "quarry": "Industrial", "park": "Public/Open", "garden": "Public/Open", "pitch": "Public/Open",
    "golf_course": "Public/Open", "nature_reserve": "Protected", "wood": "Forest", "scrub": "Forest", "heath": "Public/Open",
    "grassland": "Public/Open", "beach": "Public/Open", "water": "Water/Wetland", "wetland": "Water/Wetland", "coastline": "Water/Wetland",
    "protected_area": "Protected", "office": "Commercial", "retail_building": "Commercial", "industrial_building": "Industrial",
    "residential_building": "Residential", "commercial_building": "Commercial", "apartments": "Residential", "house": "Residential",
    "warehouse": "Industrial", "highway": "Transportation", "aeroway": "Transportation", "parking": "Transportation",
}
#: Words anywhere in the tags that decide where no tag value does, in this order.
LAND_USE_WORDS = (
    ("retail|shop", "Commercial"),
    ("rail|transit|transport", "Transportation"),
    ("park|recreation|golf|garden", "Public/Open"),
    ("forest|wood|scrub", "Forest"),
    ("wetland|water|reservoir|river|bay|lagoon", "Water/Wetland"),
    ("nature_reserve|protected", "Protected"),
)
UNKNOWN = "Unknown"
#: Fields that the registry always sets, and those that it fills only where the record has nothing.
OVERWRITTEN = {"api_number": "string", "latitude": "double", "longitude": "double", "land_use_type": "string"}
FILLED = {
    "lease_name": "string", "well_number": "string", "elevation": "double", "elevation_datum": "string", "well_type": "string", "status": "string",
    "measured_depth": "double", "true_depth": "double", "deepest_formation": "string", "deviation": "string", "county": "string",
}


def lookup(value: Column, table: dict[str, str]) -> Column:
    """A literal map's value of a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def first_per_key(registry: DataFrame, key: str, order: str) -> DataFrame:
    """The first registry row of each trimmed key, in file order: a partial aggregate, so a hot key shrinks before the shuffle."""
    rows = registry.withColumn("k", F.trim(key)).filter(F.col("k").isNotNull())
    return rows.groupBy("k").agg(F.min_by(F.struct(*[F.col(c) for c in registry.columns]), F.col(order)).alias("r")).select("k", "r.*")


def decode_registry(rows: DataFrame) -> DataFrame:
    """Registry rows as typed, decoded fields; empty strings are missing; true depth falls back to measured depth."""
    has = set(rows.columns)
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in has else F.lit(None).cast("string")
    number = lambda c: lenient_number(text(c))
    kind = text("well_type")
    return rows.select(
        "k",
        text("api_wellno").alias("api_number"),
        text("lease_name").alias("lease_name"),
        well_number(text("well_no")).alias("well_number"),
        number("lat_text").alias("latitude"),
        number("lon_text").alias("longitude"),
        number("elev_ref").alias("elevation"),
        lookup(text("ref_tops"), DATUMS).alias("elevation_datum"),
        F.coalesce(lookup(kind, WELL_TYPES), kind).alias("well_type"),
        text("well_stat").alias("status"),
        number("dtd").alias("measured_depth"),
        F.coalesce(number("tvd"), number("dtd")).alias("true_depth"),
        text("deep_fm").alias("deepest_formation"),
        lookup(text("slant"), SLANTS).alias("deviation"),
        text("cnty_name").alias("county"),
    )


def merge(records: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Records with registry fields by key: four overwritten, eleven filled where the record's are null, empty or zero.

    Records without a match stay as they are.
    """
    have = set(records.columns)
    f = found.select(F.col("k").alias("k__"), *[F.col(c).alias(f"r__{c}") for c in found.columns if c != "k"])
    joined = records.join(f, F.trim(key) == F.col("k__"), "left")
    hit = F.col("k__").isNotNull()
    own = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    reg = lambda c, t: F.col(f"r__{c}") if f"r__{c}" in joined.columns else F.lit(None).cast(t)
    out = joined.withColumn("matched", hit)
    new = {c: F.when(hit, reg(c, t)).otherwise(own(c, t)) for c, t in OVERWRITTEN.items()}
    new |= {c: F.when(hit, first_truthy(own(c, t), reg(c, t), "string" if t == "string" else "number")).otherwise(own(c, t)) for c, t in FILLED.items()}
    return out.withColumns(new).drop("k__", *[c for c in joined.columns if c.startswith("r__")])


def enrichment_outcome(requested: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Per requested file: not_found, no_key, no_match or enriched."""
    m = merged.select(F.col("id").alias("file_id"), F.col(key).alias("key__"), "matched")
    outcome = F.when(F.col("matched").isNull(), "not_found").when(F.coalesce(F.trim("key__"), F.lit("")) == "", "no_key").when(~F.col("matched"), "no_match").otherwise("enriched")
    return requested.select("file_id").distinct().join(m, "file_id", "left").select("file_id", outcome.alias("outcome"))


def tag_key(tags: Column) -> Column:
    """The tag value that decides a feature's class: seven tags by precedence, then kinds of building."""
    t = lambda k: F.nullif(F.try_element_at(tags, F.lit(k)), F.lit(""))
    first = F.coalesce(*[t(k) for k in ("landuse", "leisure", "natural", "boundary")], F.when(t("amenity") == "parking", "parking"), F.when(t("highway").isNotNull(), "highway"), F.when(t("aeroway").isNotNull(), "aeroway"))
    b = F.lower(t("building"))
    building = F.when(b.rlike("office|commercial"), "commercial_building").when(b.rlike("apartments|residential|house"), "residential_building").when(b.rlike("warehouse|industrial"), "industrial_building")
    return F.coalesce(F.lower(first), building, F.lit(""))


def land_use_class(tags: str) -> Column:
    """The land-use class of a feature's tags.  Tags, key and text are named once each: a filter by the class that the planner
    moves below would copy the tags' own expression to each place that names them."""

    def by_words(everything: Column) -> Column:
        out = F.when(everything.isNull(), UNKNOWN)
        for words, kind in LAND_USE_WORDS:
            out = out.when(everything.rlike(words), kind)
        return out.otherwise(UNKNOWN)

    of = lambda t: F.coalesce(let(tag_key(t), lambda key: lookup(key, LAND_USE)), let(F.lower(F.to_json(t)), by_words))
    return let(F.col(tags), of)


def _cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size).cast("long")


def within(points: DataFrame, features: DataFrame, metres: float, max_latitude: float = 60.0, most: int = 4096) -> DataFrame:
    """Pairs of a point and a feature at most ``metres`` apart, from equal grid cells; each feature stands in its own and
    the eight cells around it.  points: (point_id, lat, lon); features: (feature_id, label, f_lat, f_lon).

    Cells are as high as the radius and, up to ``max_latitude``, at least as wide.  Points beyond it meet by a band of
    latitude alone, so no pair is lost near the poles.  A cell with more than most x most meetings is shared by several tasks.
    Features stand in up to twelve cells each, which the planner does not count, so it is told to shuffle them.  Where many rows
    are at equal places, see near_sums and nearest_features, which compare places.
    """
    import math

    high = metres / 111_000.0
    wide = high / math.cos(math.radians(max_latitude)) * 1.01
    columns = math.floor(360.0 / wide)
    width = 360.0 / columns
    inner = lambda lat: F.abs(lat) < max_latitude - 1.0
    column = lambda lon: F.pmod(_cell(lon + 180.0, width), F.lit(columns))
    around = F.expr("explode(array(-1L, 0L, 1L))")
    p = points.withColumn("gy", _cell(F.col("lat"), high)).withColumn("gx", F.when(inner(F.col("lat")), column(F.col("lon"))).otherwise(F.lit(-1).cast("long")))
    f = features.filter(F.col("f_lat").isNotNull() & F.col("f_lon").isNotNull()).withColumn("gy", _cell(F.col("f_lat"), high) + F.lit(0)).withColumn("dy", around)
    f = f.withColumn("gy", F.col("gy") + F.col("dy")).withColumn("gx", F.explode(F.array_distinct(F.array(*[F.pmod(column(F.col("f_lon")) + d, F.lit(columns)) for d in (-1, 0, 1)], F.lit(-1).cast("long"))))).drop("dy")
    # a dense cell is cut into blocks of its points by blocks of its features, so no task compares more than one of each
    dense = p.groupBy("gy", "gx").agg(F.count("*").alias("np")).join(f.groupBy("gy", "gx").agg(F.count("*").alias("nf")).hint("merge"), ["gy", "gx"]).filter(F.col("np") * F.col("nf") > most * most)
    dense = dense.select("gy", "gx", F.ceil(F.col("np") / most).cast("int").alias("pb"), F.ceil(F.col("nf") / most).cast("int").alias("fb"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    p = p.join(dense, ["gy", "gx"], "left").withColumn("p__", own("point_id", F.col("pb"))).withColumn("f__", every(F.col("fb"))).drop("pb", "fb")
    f = f.join(dense, ["gy", "gx"], "left").withColumn("f__", own("feature_id", F.col("fb"))).withColumn("p__", every(F.col("pb"))).drop("pb", "fb")
    near = p.join(f.hint("merge"), ["gy", "gx", "p__", "f__"]).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")))
    return near.filter(F.col("distance") <= metres).drop("gy", "gx", "p__", "f__")


def _point_places(points: DataFrame) -> DataFrame:
    """The different places of points, each as one."""
    return points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct().withColumn("point_id", F.struct("lat", "lon"))


def near_sums(points: DataFrame, features: DataFrame, metres: float) -> DataFrame:
    """(point_id, n_near, ids) of points near any feature: how many there are within the radius, and the sum of their ids.

    Equal places are compared once: those of features with their number and sum, those of points without their ids.
    """
    there = features.groupBy("f_lat", "f_lon").agg(F.count("*").alias("n"), F.sum("feature_id").alias("s")).withColumn("feature_id", F.struct("f_lat", "f_lon"))
    near = within(_point_places(points), there, metres).groupBy("lat", "lon").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return points.join(near, ["lat", "lon"]).groupBy("point_id").agg(F.sum("n").alias("n_near"), F.sum("s").alias("ids"))


def nearest_features(points: DataFrame, features: DataFrame, metres: float, most: int) -> DataFrame:
    """points with ``nearest``, the up to ``most`` nearest features within the radius as (distance, feature_id, label), ties by
    id, an id once; null if there is none.  Equal places are compared once: of a place's features those of the least ids count."""
    least = Window.partitionBy("f_lat", "f_lon").orderBy("feature_id")
    there = features.groupBy("f_lat", "f_lon", "feature_id").agg(F.min("label").alias("label"))
    there = there.withColumn("n__", F.row_number().over(least)).filter(F.col("n__") <= most).drop("n__")
    by = Window.partitionBy("lat", "lon").orderBy("b.distance", "feature_id")
    near = within(_point_places(points), there, metres).groupBy("lat", "lon", "feature_id").agg(F.min(F.struct("distance", "feature_id", "label")).alias("b"))
    near = near.withColumn("n__", F.row_number().over(by)).filter(F.col("n__") <= most)
    best = near.groupBy("lat", "lon").agg(F.array_sort(F.collect_list("b")).alias("nearest"))
    return points.join(best, ["lat", "lon"], "left")


def nearest_label(points: DataFrame, features: DataFrame, metres: float = 1000.0, asked: Column | None = None) -> DataFrame:
    """Per point the label of the nearest feature that has a known one within the radius, ties by feature id; else Unknown, or
    null where ``asked`` is false."""
    found = nearest_features(points, features.filter(F.col("label") != UNKNOWN), metres, 1).withColumn("b", F.get("nearest", F.lit(0)))
    return found.select("point_id", F.coalesce("b.label", F.when(F.lit(True) if asked is None else asked, UNKNOWN)).alias("label"), F.col("b.feature_id").alias("feature_id"))


def nearest_other_label(points: DataFrame, features: DataFrame, metres: float = 1000.0) -> DataFrame:
    """(point_id, label): the same of the features that do not have the point's own id."""
    found = nearest_features(points, features.filter((F.col("label") != UNKNOWN) & F.col("feature_id").isNotNull()), metres, 2)
    other = F.get(F.filter("nearest", lambda b: b["feature_id"] != F.col("point_id")), F.lit(0))
    return found.select("point_id", F.coalesce(other["label"], F.lit(UNKNOWN)).alias("label"))


def land_use_of_points(points: DataFrame, features: DataFrame, metres: float = 1000.0) -> DataFrame:
    """(point_id, label, feature_id): the class of the nearest feature whose tags tell one, within the radius.

    features: (feature_id, tags, lat, lon, minlat, maxlat, minlon, maxlon); its own centre counts before its bounds', one
    without either is nowhere.  points: (point_id, lat, lon); one at zero latitude or longitude, or without, is not looked up.
    """
    # Each row's class and place are made once, in an array of one, below which the planner moves no filter with copies of them.
    bounds = ("lat", "lon", "minlat", "maxlat", "minlon", "maxlon")
    centre = let(F.struct(*bounds), lambda b: feature_centre(*[b[c] for c in bounds]))
    known = F.filter(F.array(F.struct(land_use_class("tags").alias("label"), centre.alias("at"))), lambda r: (r["label"] != UNKNOWN) & r["at"].isNotNull())
    placed = features.select("feature_id", F.explode(known).alias("r")).select("feature_id", "r.label", F.col("r.at.lat").alias("f_lat"), F.col("r.at.lon").alias("f_lon"))
    asked = let(F.struct("lat", "lon"), lambda p: F.when((F.coalesce(p["lat"], F.lit(0.0)) != 0) & (F.coalesce(p["lon"], F.lit(0.0)) != 0), p))
    at = points.select("point_id", F.explode(F.array(asked)).alias("p")).select("point_id", "p.lat", "p.lon")
    found = nearest_label(at, placed, metres, F.col("lat").isNotNull())
    return found.select("point_id", "label", "feature_id")


def reprocess_plan(files: DataFrame, mine: DataFrame, queued: DataFrame, active: DataFrame, extract: bool = True, process: bool = True, force: bool = False, requested: DataFrame | None = None) -> DataFrame:
    """Per requested file: what would be done, the queue mode, and the first reason to skip it.

    files: (id, job_id, extraction_status, has_text); mine: (job_id) that the user may see.
    """
    if not (extract or process):
        raise ValueError("ask for extraction, processing or both")
    ask = (requested if requested is not None else files.select(F.col("id").alias("file_id"))).select("file_id").distinct()
    found = ask.join(files.withColumnRenamed("id", "file_id"), "file_id", "left").join(mine.select("job_id").distinct().withColumn("own", F.lit(True)), "job_id", "left")
    for name, table in (("q", queued), ("a", active)):
        found = found.join(table.select("file_id").distinct().withColumn(name, F.lit(True)), "file_id", "left")
    done = F.col("extraction_status") == "completed"
    will_extract = F.lit(extract) & (F.lit(force) | ~done)
    will_process = F.lit(process) & (F.col("has_text") | will_extract)
    #: The reasons, in the order in which they are looked at.
    reason = (
        F.when(F.col("job_id").isNull(), "File not found")
        .when(F.col("own").isNull(), "Access denied")
        .when(F.lit(process) & ~will_extract & ~F.col("has_text"), "No extracted text available for AI processing")
        .when(F.lit(extract and not force) & done, "Extraction already completed (use forceExtraction: true to override)")
        .when(F.col("q"), "File already in processing queue")
        .when(F.col("a"), "File currently being processed")
    )
    mode = F.when(will_extract & will_process, "force-full" if force else "both").when(will_extract, "extraction-only").when(will_process, "reprocess")
    return found.select("file_id", F.coalesce(will_extract, F.lit(False)).alias("will_extract"), F.coalesce(will_process, F.lit(False)).alias("will_process"), reason.alias("skip_reason"), F.when(reason.isNull(), mode).alias("queue_mode"))


def latest_by(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by an order, as an aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def first_by(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def changed_versions(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before under their key, numbered."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("before", F.lag(value).over(w)).withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) | ~F.col(value).eqNullSafe(F.col("before")))
    return kept.withColumn("version", F.row_number().over(w)).drop("before", "k")


def any_label(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
