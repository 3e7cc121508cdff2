"""Names, paths and identifiers as Column expressions (no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Recorder file-name patterns, tried in this order, first match wins.
# Columns: name, pattern, start format, recorder type, gps sync.
FILENAME_PATTERNS = (
    ("span_gps", r"S(\d{8}T\d{6}\.\d{6}\+\d{4})_E(\d{8}T\d{6}\.\d{6}\+\d{4})_([+-]\d+\.\d+)([+-]\d+\.\d+)\.(?:wav|flac)",
     "yyyyMMdd'T'HHmmss.SSSSSSxx", "SOLARBAR", True),
    ("span_gps_segment", r"S(\d{8}T\d{6}\.\d{6}\+\d{4})_E(\d{8}T\d{6}\.\d{6}\+\d{4})_([+-]\d+\.\d+)([+-]\d+\.\d+)_00000_000\.(?:wav|flac)",
     "yyyyMMdd'T'HHmmss.SSSSSSxx", "SOLARBAR", True),
    ("rec_gps", r"(\d{8}T\d{6}\+\d{4})_REC_([+-]\d+\.\d+)([+-]\d+\.\d+)\.(?:wav|flac)",
     "yyyyMMdd'T'HHmmssxx", "SOLARBAR", False),
    ("rec", r"(\d{8}T\d{6}\+\d{4})_REC\.(?:wav|flac)", "yyyyMMdd'T'HHmmssxx", "SOLARBAR", False),
    ("segment", r"(S4A\d{5})_(\d{1})_(\d{8}_\d{6})_\d{3}\.(?:wav|flac)", "yyyyMMdd_HHmmssxx", "S4A", False),
    ("synced_dollar", r"(S4A\d{5})_(\d{8})\$(\d{6})\.(?:wav|w4v|flac)$", "yyyyMMdd_HHmmssxx", "S4A", True),
    ("synced", r"(S4A\d{5})_(\d{8}_\d{6})\.(?:wav|w4v|flac)$", "yyyyMMdd_HHmmssxx", "S4A", True),
)
# Fixed value: this recorder type keeps one clock offset all year.
FIXED_CLOCK_OFFSET = "-0500"
RECORDER_ID_IN_PATH = r"BARLT_\d{8}"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def ancestors(path: Column) -> Column:
    """Every folder above ``path``, nearest last, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def has_extension(name: Column, *extensions: str) -> Column:
    return F.lower(name).rlike(r"\.(?:%s)$" % "|".join(extensions))


def is_wave(name: Column) -> Column:
    return has_extension(name, "wav")


def is_flac(name: Column) -> Column:
    return has_extension(name, "flac")


def recorder_from_path(path: Column) -> Column:
    """The recorder id in a path; null unless exactly one distinct id occurs."""
    ids = F.array_distinct(F.regexp_extract_all(path, F.lit(RECORDER_ID_IN_PATH), F.lit(0)))
    return F.when(F.size(ids) == 1, ids[0])


def fixed_offset_time(text: Column) -> Column:
    """``yyyyMMdd_HHmmss`` on the fixed-offset recorder clock -> instant."""
    return F.try_to_timestamp(F.concat(text, F.lit(FIXED_CLOCK_OFFSET)), F.lit("yyyyMMdd_HHmmssxx"))


def parse_filename(path: Column) -> Column:
    """Struct of what the file name tells: recorder, type, channel, sync, times, position."""
    name, folder = basename(path), dirname(path)
    pats = {p[0]: p for p in FILENAME_PATTERNS}

    def grp(key: str, n: int) -> Column:
        return F.regexp_extract(name, pats[key][1], n)

    def ts(key: str, text: Column) -> Column:
        return F.try_to_timestamp(text, F.lit(pats[key][2]))

    matched = F.when(F.lit(False), F.lit(""))
    for key, pattern, *_ in FILENAME_PATTERNS:
        matched = matched.when(name.rlike(pattern), F.lit(key))

    def fields(hit: Column) -> Column:
        def choose(values: dict[str, Column], default=None) -> Column:
            out = F.when(F.lit(False), next(iter(values.values())))
            for key, value in values.items():
                out = out.when(hit == key, value)
            return out if default is None else out.otherwise(F.lit(default))

        solar = recorder_from_path(folder)
        return F.struct(
            path.alias("filepath"), folder.alias("dirpath"), name.alias("filename"),
            F.when(hit.isNull(), F.lit("")).otherwise(choose({
                "span_gps": solar, "span_gps_segment": solar, "rec_gps": solar, "rec": solar,
                "segment": grp("segment", 1), "synced_dollar": grp("synced_dollar", 1),
                "synced": grp("synced", 1)})).alias("recorder"),
            choose({p[0]: F.lit(p[3]) for p in FILENAME_PATTERNS}, "").alias("recorder_type"),
            choose({"segment": grp("segment", 2)}).alias("channel"),
            choose({p[0]: F.lit(p[4]) for p in FILENAME_PATTERNS}, False).alias("gps_sync"),
            choose({
                **{k: ts(k, grp(k, 1)) for k in ("span_gps", "span_gps_segment", "rec_gps", "rec")},
                "segment": fixed_offset_time(grp("segment", 3)),
                "synced_dollar": fixed_offset_time(F.concat_ws("_", grp("synced_dollar", 2), grp("synced_dollar", 3))),
                "synced": fixed_offset_time(grp("synced", 2))}).alias("start_datetime"),
            choose({k: ts(k, grp(k, 2)) for k in ("span_gps", "span_gps_segment")}).alias("end_datetime"),
            choose({"span_gps": grp("span_gps", 3), "span_gps_segment": grp("span_gps_segment", 3),
                    "rec_gps": grp("rec_gps", 2)}).try_cast("double").alias("latitude"),
            choose({"span_gps": grp("span_gps", 4), "span_gps_segment": grp("span_gps_segment", 4),
                    "rec_gps": grp("rec_gps", 3)}).try_cast("double").alias("longitude"))

    # the pattern tests run once per name, not once per field
    return let(matched, fields)


def birdcode(common_name: Column) -> Column:
    """Candidate code: letters and digits kept, upper case."""
    return F.upper(F.regexp_replace(common_name, r"[^A-Za-z0-9]", ""))


def profile_code(common_name: Column) -> Column:
    """Profile key: letters only. Differs from ``birdcode`` when a name holds a digit."""
    return F.upper(F.regexp_replace(common_name, r"[^A-Za-z]", ""))


def call_id(common_name: Column, group: Column, second: Column, zone: str | None = None) -> Column:
    """``{code}_{group}_{yyyyMMdd-HHmmss}`` with the time shown in the site zone."""
    shown = F.from_utc_timestamp(second, zone) if zone else second
    return F.concat_ws("_", birdcode(common_name), group.cast("string"),
                       F.date_format(shown, "yyyyMMdd-HHmmss"))


def sanitize(text: Column) -> Column:
    """File-system-safe form: spaces and other runs become ``_``; null -> empty, empty -> ``item``."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), " ", "_")
    cleaned = F.regexp_replace(cleaned, r"[^A-Za-z0-9._-]+", "_")
    return F.when(text.isNull(), F.lit("")).when(cleaned == "", F.lit("item")).otherwise(cleaned)


def species_from_clip_name(path: Column) -> Column:
    """Reference-clip name ``<species> <two digits> ...`` -> species, else null."""
    hit = F.regexp_extract(basename(path), r"^(.+?)\s+\d{2}\s+", 1)
    return F.when(hit != "", hit)


def split_label(line: Column) -> Column:
    """``Scientific_Common`` split at the first underscore."""
    parts = F.split(line, "_", 2)
    return F.struct(parts[0].alias("species"), F.get(parts, F.lit(1)).alias("common_name"))


def is_recorder_dir(name: Column) -> Column:
    return name.rlike(r"^BARLT_\d{8}$") | name.rlike(r"^S4A\d{5}.*$")


def is_collection_date(name: Column) -> Column:
    return name.rlike(r"^\d{8}$") & F.try_to_date(name, "yyyyMMdd").isNotNull()


def looks_like_card_id(name: Column) -> Column:
    """Upper-case code such as a storage-card id; real group names hold a lower-case letter."""
    base = F.regexp_replace(name, r"_\d+$", "")
    return F.coalesce(base.rlike(r"^[A-Z0-9_]{4,20}$") & base.rlike(r"[A-Z]"), F.lit(False))


def is_canonical_dir(name: Column) -> Column:
    return name.rlike(r"^(BARLT_\d{8}|S4A\d{5}[^_]*)_\d{8}_\d{8}(_\d+)?$")


def canonical_dir(recorder: Column, start: Column, end: Column, suffix: Column | None = None) -> Column:
    day = lambda c: F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit("UNKNOWN"))
    parts = [recorder, day(start), day(end)] + ([suffix] if suffix is not None else [])
    return F.concat_ws("_", *parts)
