"""Parsing, naming and formatting as Column expressions. Blank text is the null of the file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Review states by code, and the spelling that each folded form stands for.
STATUS_BY_CODE = ("Created", "Fixed", "Not_An_Issue", "Skipped", "Deleted", "Already_Fixed", "Too_Hard", "Answered", "Validated", "Disabled")
STATUS_BY_FOLD = {
    "created": "Created", "fixed": "Fixed", "not_an_issue": "Not_An_Issue", "false_positive": "Not_An_Issue", "skipped": "Skipped", "deleted": "Deleted",
    "already_fixed": "Already_Fixed", "alreadyfixed": "Already_Fixed", "too_hard": "Too_Hard", "toohard": "Too_Hard", "cant_complete": "Too_Hard", "can't_complete": "Too_Hard",
}
NAI_FOLDS = ("not_an_issue", "notanissue", "false_positive", "falsepositive")
#: Themes of review comments in order of precedence.
THEMES = (("golf", ("golf",)), ("beach/sand", ("beach", "sand")), ("gps_scatter", ("gps", "scatter")), ("event", ("event", "marathon", "race")), ("climbing", ("climb",)))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def parse_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def parse_tags(c: Column) -> Column:
    """A JSON object of strings; an empty map where it cannot be read."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def normalize_status(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(" "), F.lit("_"))


def fold_status(c: Column) -> Column:
    """A review state in lower case with underscores; codes become names; blank and null become ''."""
    text = F.trim(c)
    by_code = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_BY_CODE) for x in (i, s.lower())])
    code = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(by_code[code], F.regexp_replace(F.lower(text), "[ -]", "_"), F.lit(""))


def canonical_status(c: Column) -> Column:
    """Any spelling or code of a review state in its one form; unknown ones as they are."""
    by_fold = F.create_map(*[F.lit(x) for pair in STATUS_BY_FOLD.items() for x in pair])
    folded = fold_status(c)
    return F.when(folded == "", "").otherwise(F.coalesce(by_fold[folded], by_fold[F.replace(folded, F.lit("_"), F.lit(""))], F.trim(c)))


def is_not_an_issue(c: Column) -> Column:
    folded = fold_status(c)
    return folded.isin(*NAI_FOLDS) | F.replace(folded, F.lit("_"), F.lit("")).isin(*NAI_FOLDS)


def fixed_digits(c: Column, digits: int) -> Column:
    """A number with at most ``digits`` decimals, no trailing zeros, and never a negative zero."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", c), r"\.?0+$", "") if digits else F.format_string("%.0f", c)
    return F.when(text == "-0", "0").otherwise(text)


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.format_string("%.1f%%", 100.0 * a / b)).otherwise("")


def candidate_id(z: Column, x: Column, y: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("/", z, x, y, row, col)


def split_candidate_id(c: Column) -> list[Column]:
    """z, x, y, row, col of an id, null where it has not five parts."""
    parts = F.split(c, "/")
    return [F.when(F.size(parts) == 5, F.get(parts, F.lit(i)).try_cast("int")).alias(n) for i, n in enumerate(("z", "x", "y", "row", "col"))]


def tile_key(c: Column) -> Column:
    return F.substring_index(c, "/", 3)


def feature_id(properties: Column) -> Column:
    return F.coalesce(F.nullif(properties["id"], F.lit("")), F.nullif(properties["candidate_id"], F.lit("")))


def infer_layer(name: Column) -> Column:
    """The heat layer that a challenge's name tells, if any."""
    low = F.lower(name)

    def told(layer: str) -> Column:
        return low.endswith(f" {layer}") | low.contains(f" {layer} ")

    return F.when(low.contains(" api test"), F.lit(None)).when(told("ride"), "ride").when(told("run"), "run").when(told("all"), "all")


def is_smoke_challenge(name: Column, comment: Column | None = None) -> Column:
    return F.lower(F.concat_ws(" ", name, comment) if comment is not None else name).rlike("api test|smoke[-_]test")


def comment_theme(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.trim(low) == "", "other/no_comment")
    for theme, words in THEMES:
        out = out.when(low.rlike("|".join(words)), theme)
    return out.otherwise("other")


def gap(limit: float, c: Column) -> Column:
    """What is missing to the limit; null stays null."""
    return limit - c


def annotate(properties: Column, defaults: dict[str, Column], overrides: dict[str, Column]) -> Column:
    """A property map with defaults that it may hold already and overrides that replace what it holds."""

    def as_map(entries: dict[str, Column]) -> Column:
        return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])

    return F.map_from_entries(F.map_entries(F.map_concat(F.map_filter(as_map(defaults), lambda k, _: ~F.map_contains_key(properties, k)), F.map_filter(properties, lambda k, _: ~k.isin(*overrides)), as_map(overrides))))


def redact(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def lag_seconds(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(later) - F.unix_timestamp(earlier))


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")


def cache_digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def challenge_name(region: Column, layer: Column, day: Column, copy: Column) -> Column:
    """A dated name; copies of a day are numbered from 2."""
    return F.concat(region, F.lit(" "), layer, F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.when(copy > 1, F.concat(F.lit("-"), copy)).otherwise(""))


def task_identities(task: Column) -> Column:
    """All names that a task record (JSON) goes by: its own, then those of its features."""
    own = F.coalesce(F.get_json_object(task, "$.name"), F.get_json_object(task, "$.taskName"))
    schema = "array<struct<properties map<string,string>>>"
    features = F.from_json(F.coalesce(F.get_json_object(task, "$.geometries.features"), F.get_json_object(task, "$.geometries")), schema)
    named = F.flatten(F.transform(features, lambda f: F.array(*[f["properties"][k] for k in ("id", "candidate_id", "name")])))
    return F.filter(F.concat(F.array(own), F.coalesce(named, F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")


def task_candidate_id(task: Column) -> Column:
    return F.trim(F.get(task_identities(task), F.lit(0)))
