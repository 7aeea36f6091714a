"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIVE = r"(?i)\b(?:AD\s*)?(\d{4}|\d{2})-(\d{2})-(\d{2})(?:R\d+)?\b"
# Words that count as no keyword.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "all", "model")


def _full_year(year: Column) -> Column:
    return F.when(F.length(year) == 4, year).when(F.try_to_number(year, F.lit("99")) <= 39, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))


def directive_number(text: Column) -> Column:
    """First directive number, years of two digits put into 1940..2039; null where none."""
    year, week, no = (F.regexp_extract(text, DIRECTIVE, i) for i in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", _full_year(year), week, no))


def directive_numbers(text: Column) -> Column:
    """All distinct directive numbers of a text, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DIRECTIVE), F.lit(0))
    return F.array_distinct(F.transform(found, directive_number))


def match_text(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")


def optional_text(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def target_key(*parts: Column) -> Column:
    clean = [F.coalesce(F.regexp_replace(F.lower(F.trim(p)), r"\s+", " "), F.lit("")) for p in parts]
    return F.concat_ws("|", *clean)


def registration(s: Column) -> Column:
    return F.translate(F.upper(F.trim(s)), "- ", "")


def tag_value(s: Column, fallback: str) -> Column:
    safe = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"[^A-Za-z0-9_.:/=+@-]+", "-")
    cut = F.substring(F.regexp_replace(safe, "^-+|-+$", ""), 1, 128)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def source_status(s: Column) -> Column:
    """A source's own status word as current, superseded, rescinded or snake case; none is current."""
    s = F.translate(F.lower(F.trim(s)), " ", "_")
    known = F.when(s.isin("active", "current", "final", "published"), "current").when(s.contains("supersed"), "superseded")
    return F.when(F.coalesce(s, F.lit("")) == "", "current").otherwise(known.when(s.contains("cancel") | s.contains("rescinded"), "rescinded").otherwise(F.substring(s, 1, 64)))


def keywords(text: Column) -> Column:
    """Distinct words of three letters, digits and inner dashes or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def split_values(s: Column) -> Column:
    """Parts between pipes, semicolons and commas, without blanks and empty ones; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "[|;,]"), lambda x: F.trim(x)), lambda x: x != "")


def list_values(s: Column) -> Column:
    """A JSON list's items as text, any other text as the only item; null and blank have none."""
    one = F.trim(s)
    parsed = F.when(one.startswith("["), F.from_json(one, "array<string>"))
    return F.when(F.coalesce(one, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(one)))


def date_of(s: Column) -> Column:
    """A date as 2020-01-31, 01/31/2020 or 2020/01/31, whichever fits first; null where none does."""
    forms = {"yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$"}
    return F.coalesce(*(F.when(s.rlike(shape), F.try_to_date(s, form)) for form, shape in forms.items()))


def component_role(kind: Column, sub: Column) -> Column:
    """The role of a component that a target's type and subtype name; the first that fits."""
    text = F.lower(F.concat_ws(" ", kind, sub))
    has = lambda *words: F.greatest(*(text.contains(w) for w in words)) if len(words) > 1 else text.contains(words[0])
    rotor = has("rotor")
    return (
        F.when(rotor & has("drive"), "drivetrain_transmission").when(rotor & has("system", "blade", "hub"), "rotor_system")
        .when(has("rotorcraft", "helicopter"), "rotorcraft_airframe").when(has("engine"), "engine").when(has("propeller"), "propeller")
        .when(has("appliance", "equipment"), "appliance").when(has("aircraft", "airplane"), "airframe").otherwise("unknown")
    )


def product_of(text: Column) -> Column:
    """(product_type, make, model) of a product's wording: its noun tells the type, the first other word is the make, the rest the model."""
    low = F.lower(text)
    kind = F.when(low.contains("engine"), "Engine").when(low.contains("propeller"), "Propeller").when(low.contains("rotorcraft") | low.contains("helicopter"), "Rotorcraft").otherwise("Aircraft")
    bare = F.regexp_replace(F.trim(text), r"(?i)\b(airplanes?|aircraft|engines?|propellers?|rotorcraft|helicopters?)\b", "")
    words = F.filter(F.split(F.translate(bare, ";", " "), r"\s+"), lambda w: w != "")
    return F.struct(kind.alias("product_type"), F.get(words, F.lit(0)).alias("make"), F.nullif(F.array_join(F.slice(words, F.lit(2), F.size(words)), " "), F.lit("")).alias("model"))


def safe_filename(s: Column) -> Column:
    """The last part of a path, with other characters than letters, digits, dot, dash and underscore as underscores."""
    return F.regexp_replace(F.element_at(F.split(s, r"[/\\\\]"), -1), "[^A-Za-z0-9._-]+", "_")


def tag_number(tags: Column, key: str) -> Column:
    """A tag's number; null where it is missing, none, or negative."""
    value = F.trim(F.try_element_at(tags, F.lit(key))).try_cast("double")
    return F.when(value >= 0, value)


def issue_severity(status: Column) -> Column:
    return F.when(status == "missing", "high").when(status.isin("snapshot_unparseable", "historical_source_unavailable"), "medium").otherwise("low")


def gap_reason(title: Column, numbers: Column) -> Column:
    """Why a number may be missing from a source, by its document's title and how many numbers that has."""
    low = F.lower(title)
    return F.when(title.isNull(), "no_metadata").when(low.contains("correction"), "correction").when(low.contains("emergency"), "emergency").when(numbers == 0, "number_needs_detail").otherwise("gap_or_mismatch")


def upload_tags(customer_tag: Column, organization: Column, aircraft_tag: Column, aircraft: Column, upload: Column, project: str, stage: str = "initial-ocr", environment: str = "pilot") -> Column:
    """A map of an upload's cost tags: the given ones of its account and aircraft, else made from their ids."""
    made = lambda prefix, c: tag_value(F.concat(F.lit(prefix), c.cast("string")), "")
    account = F.coalesce(F.nullif(customer_tag, F.lit("")), made("acct-", organization))
    plane = F.coalesce(F.nullif(aircraft_tag, F.lit("")), made("aircraft-", aircraft))
    tags = {
        "Project": F.lit(project), "Environment": F.lit(environment), "Application": F.lit(project), "CustomerAccount": account, "Aircraft": plane,
        "Upload": made("upload-", upload), "BillableAccount": account, "BillingStage": tag_value(F.lit(stage), "ocr"),
    }
    return F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v)))


def agency_names(agencies: Column) -> Column:
    """Names of agencies(name, slug), their slugs where they have none; null agencies have none."""
    one = lambda a: F.trim(F.coalesce(F.nullif(a["name"], F.lit("")), F.nullif(a["slug"], F.lit("")), F.lit("")))
    return F.coalesce(F.transform(F.filter(agencies, lambda a: a.isNotNull()), one), F.array().cast("array<string>"))


def keyword_overlap(a: Column, b: Column, shown: int = 4) -> Column:
    """The first few of the words that two arrays share, sorted, as text."""
    return F.array_join(F.slice(F.array_sort(F.array_intersect(a, b)), 1, shown), ", ")
