"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371000.0
#: Content types by extension; anything else is a stream of bytes.  The patterns of slugs, titles and
#: sanitised texts below are fixed values too: their results are compared as strings.
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: Roles by rising rank.
ROLES = ("viewer", "member", "admin", "owner")


def slug(name: Column) -> Column:
    """Lower case; only letters, digits, space and hyphen; spaces to hyphens; runs of hyphens to one; trimmed."""
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"))


def owner_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "-")


def digits_of(value: Column) -> Column:
    """The digits of a string, or null if it has none."""
    return F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit(""))


def first_with_digits(values: list[Column]) -> Column:
    """Digits of the first value that has any."""
    return F.coalesce(*[digits_of(v) for v in values])


def normal_permit(value: Column) -> Column:
    """Without surrounding space and leading zeros; all zeros become one; an empty key is none."""
    short = F.regexp_replace(F.trim(value), "^0+", "")
    return F.when(value.isNull() | (value == ""), None).otherwise(F.when(short == "", "0").otherwise(short))


def permit_of_filename(name: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit(""))


def reconcile(from_name: Column, from_record: Column) -> tuple[Column, Column]:
    """(the key: the file name's, else the record's; whether both agree)."""
    a, b = normal_permit(from_name), normal_permit(from_record)
    return F.coalesce(a, b), a.eqNullSafe(b)


def well_number(value: Column) -> Column:
    """``A / B`` as ``A-B``."""
    return F.regexp_replace(value, r"^([A-Za-z0-9]+)\s*/\s*([A-Za-z0-9]+)$", "$1-$2")


def lenient_number(value: Column) -> Column:
    """The number that a string begins with, else null."""
    number = F.regexp_extract(value, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.nullif(number, F.lit("")).try_cast("double")


def block_markdown(text: Column, label: Column) -> Column:
    """A block's text in the markdown of its label; other labels leave it as it is."""
    kind = F.lower(F.coalesce(label, F.lit("")))
    wrap = {
        "doc_title": ("# ", ""),
        "header": ("## ", ""),
        "paragraph_title": ("### ", ""),
        "figure_title": ("#### ", ""),
        "footer": ("*", "*"),
        "vision_footnote": ("<small>", "</small>"),
        "number": ("**", "**"),
    }
    out = F.when(F.coalesce(text, F.lit("")) == "", "")
    for name, (before, after) in wrap.items():
        out = out.when(kind == name, F.concat(F.lit(before), text, F.lit(after)))
    return out.otherwise(text)


def clean_table_text(text: Column) -> Column:
    """Escaped double quotes become single quotes."""
    return F.replace(text, F.lit('\\"'), F.lit("'"))


def sanitised(text: Column) -> Column:
    """Without angle brackets, script protocols and event handlers, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[<>]", ""), "(?i)javascript:", ""), r"(?i)on\w+=", "")
    return F.trim(plain)


def clean_title(text: Column) -> Column:
    """Without outer quotes, a leading Job and a trailing Extraction; null under 3 characters, cut to 100."""
    t = F.regexp_replace(text, "^[\"']|[\"']$", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^Job\s+", ""), r"(?i)\s+Extraction$", ""))
    return F.when(F.length(t) >= 3, F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 97), F.lit("..."))).otherwise(t))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def content_type(name: Column) -> Column:
    out = None
    for ext, kind in CONTENT_TYPES.items():
        out = (F if out is None else out).when(extension(name) == ext, kind)
    return out.otherwise("application/octet-stream")


def document_kind(name: Column, mime: Column | None = None) -> Column:
    """pdf, image or other, by MIME type or extension."""
    mime = F.coalesce(mime if mime is not None else F.lit(None).cast("string"), F.lit(""))
    return (
        F.when((mime == "application/pdf") | (extension(name) == ".pdf"), "pdf")
        .when(mime.startswith("image/") | name.rlike(r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"), "image")
        .otherwise("other")
    )


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def backoff_ms(retries: Column) -> Column:
    return (F.lit(5000) * F.pow(F.lit(2.0), retries)).cast("long")


def queue_health(size: Column, active: Column, wait_ms: Column) -> tuple[Column, Column]:
    """(score, class) of a queue by its size, items in progress and mean wait."""
    score = (
        F.lit(100)
        - F.when(size > 100, 20).when(size > 50, 10).otherwise(0)
        - F.when(active > 10, 15).when(active > 5, 5).otherwise(0)
        - F.when(wait_ms > 300000, 25).when(wait_ms > 60000, 10).otherwise(0)
    )
    score = F.greatest(F.lit(0), score)
    return score, F.when(score < 50, "critical").when(score < 75, "warning").otherwise("healthy")


def role_rank(role: Column) -> Column:
    """Rank of a role from 0 on; unknown roles rank -1."""
    out = None
    for k, r in enumerate(ROLES):
        out = (F if out is None else out).when(role == r, k)
    return out.otherwise(-1)


def truthy(value: Column, kind: str) -> Column:
    """Whether a value is neither null, empty, zero, NaN nor false."""
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    return F.coalesce((value != 0) & ~F.isnan(value.cast("double")), F.lit(False))


def first_truthy(a: Column, b: Column, kind: str) -> Column:
    return F.when(truthy(a, kind), a).otherwise(b)


def text_for_model(markdown: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(markdown, F.lit("")), text)


def terminal_time(status: Column, ts: Column) -> Column:
    """The event's time if it ends the work, else null."""
    return F.when(status.isin("completed", "failed"), ts)


def merge_maps(old: Column, new: Column) -> Column:
    """Key by key, the new value where the new map has the key, be it null."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))


def merge_config(old: Column, new: Column) -> Column:
    """Two levels: sections of the new configuration are merged into those of the old one, key by key."""
    empty = F.create_map().cast("map<string,map<string,string>>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), merge_maps(a, b)).otherwise(a))


#: The keys under which a record may hold its permit, in order.
PERMIT_KEYS = ("permit_number", "permitNumber", "permit_no", "permitNo", "permit", "permit_id", "permitId", "well_permit", "wellPermit", "drilling_permit", "drillingPermit")


def permit_of_record(record: Column) -> Column:
    """The digits of the first permit key of a JSON record that is a string with digits."""
    string = lambda v, key: F.try_variant_get(v, f"$.{key}", "variant")
    digits = lambda x: F.when(F.schema_of_variant(x) == "STRING", digits_of(F.try_variant_get(x, "$", "string")))
    return F.get(F.transform(F.array(F.try_parse_json(record)), lambda v: F.coalesce(*[digits(string(v, key)) for key in PERMIT_KEYS])), F.lit(0))


def feature_centre(lat: Column, lon: Column, minlat: Column, maxlat: Column, minlon: Column, maxlon: Column) -> Column:
    """A feature's own centre if both of its sides are finite, else the middle of its bounds."""
    return F.coalesce(centre(lat, lat, lon, lon), centre(minlat, maxlat, minlon, maxlon))


def centre(minlat: Column, maxlat: Column, minlon: Column, maxlon: Column) -> Column:
    """Middle of bounds, or null if a side is missing or not finite."""
    lat, lon = (minlat + maxlat) / 2, (minlon + maxlon) / 2
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(lat) & finite(lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def page_count(pages_json: Column, prior: Column) -> Column:
    """Number of pages in a JSON payload (array length, number, or an object's length, count or total), else the earlier count."""
    v = F.try_parse_json(pages_json)
    number = F.coalesce(*[F.try_variant_get(v, p, "int") for p in ("$", "$.length", "$.count", "$.total")])
    length = F.json_array_length(F.when(F.schema_of_variant(v).startswith("ARRAY"), pages_json))
    return F.coalesce(F.nullif(length, F.lit(0)), number, prior)


#: What a request may name.
EXTRACTION_MODES = ("full_extraction", "text_only")
EXTRACTION_METHODS = ("mineru", "documentai", "extendai", "paddleocr")
MODELS = {
    "openai": ("gpt-4o", "gpt-4o-2024-08-06", "gpt-4", "gpt-3.5-turbo"),
    "qwen": (
        "qwen3-max", "qwen3-max-2025-09-23", "qwen3-max-preview", "qwen-max", "qwen-max-latest", "qwen-max-2025-01-25",
        "qwen-plus", "qwen-plus-latest", "qwen-plus-2025-01-25", "qwen-flash", "qwen-flash-2025-07-28",
        "qwen-turbo", "qwen-turbo-latest", "qwen-turbo-2024-11-01",
        "qwen3-coder-plus", "qwen3-coder-plus-2025-07-22", "qwen3-coder-flash", "qwen3-coder-flash-2025-07-28",
    ),
}


def request_fault(mode: Column, config: Column) -> Column:
    """The first reason against a request, or null.  mode: null if not given; config: JSON text, null if not given, with
    ``extraction.method``, ``processing.method`` and ``processing.model``; what is missing or empty is not tested."""
    v = F.try_parse_json(config)
    given = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    extraction, method, model = given("$.extraction.method"), given("$.processing.method"), given("$.processing.model")
    known = F.lit(False)
    for name, models in MODELS.items():
        known |= (method == name) & model.isin(*models)
    said = lambda text, choices: F.lit(f"{text}. Must be one of: {', '.join(choices)}")
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    out = F.when(~mode.isin(*EXTRACTION_MODES), "Invalid extraction_mode. Must be 'full_extraction' or 'text_only'")
    out = out.when(config.isNotNull() & ~whole, "processing_config must be an object")
    out = out.when(~extraction.isin(*EXTRACTION_METHODS), said("Invalid extraction.method", EXTRACTION_METHODS))
    out = out.when(~method.isin(*MODELS), said("Invalid processing.method", tuple(MODELS)))
    for name, models in MODELS.items():
        out = out.when((method == name) & model.isNotNull() & ~known, said(f"Invalid processing.model for {name}", models))
    return out
