"""Column functions: text, number, date, invoice and file-name rules. All stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the document platform's regular expressions, and its spelled-out units and labels.
SPACE = "[\\t\\n\\u000B\\f\\r\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
TONNES = ("t", "ton", "tons", "tonne", "tonnes")
PLASTIC_LABELS = {"PET": "PET 1", "PP": "PP 5", "PVC": "PVC 3", "LDPE": "LDPE 4"}
#: Words of a domestic recycler's name when groups are promoted.
DOMESTIC = (
    "private limited", "pvt ltd", "limited", "ltd", "enterprises", "industries", "india", "indian", "mumbai", "delhi", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "surat", "jaipur", "lucknow",
    "kanpur", "nagpur", "indore", "bhopal", "visakhapatnam", "patna", "vadodara", "ludhiana", "agra", "nashik", "faridabad", "meerut", "rajkot", "kalyan", "vasai-virar", "varanasi", "srinagar", "aurangabad", "dhanbad",
    "amritsar", "navi mumbai", "allahabad", "howrah", "gwalior", "jabalpur", "coimbatore", "vijayawada", "jodhpur", "madurai", "raipur", "kota", "guwahati", "chandigarh", "solapur", "noida", "gurgaon", "rangpar",
)

#: The words when groups are listed.
DOMESTIC_SHOWN = (
    "private limited", "pvt ltd", "limited", "ltd", "enterprises", "industries", "india", "indian", "mumbai", "delhi", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "surat", "jaipur", "lucknow",
    "kanpur", "nagpur", "indore", "bhopal", "visakhapatnam", "patna", "vadodara", "ludhiana", "agra", "nashik", "faridabad", "meerut", "rajkot", "kalyan", "vasai-virar", "varanasi", "srinagar", "aurangabad", "dhanbad",
    "amritsar", "navi mumbai", "allahabad", "howrah", "gwalior", "jabalpur", "coimbatore", "vijayawada", "jodhpur", "madurai", "raipur", "kota", "guwahati", "chandigarh", "solapur", "hubli-dharwad", "bareilly", "moradabad",
    "mysore", "gurgaon", "aligarh", "jalandhar", "tiruchirappalli", "bhubaneswar", "salem", "mira-bhayandar", "warangal", "thiruvananthapuram", "guntur", "bhiwandi", "saharanpur", "gorakhpur", "bikaner", "amravati", "noida",
    "jamshedpur", "bhilai", "cuttack", "firozabad", "kochi", "bhavnagar", "dehradun", "durgapur", "asansol", "nanded", "kolhapur", "ajmer", "gulbarga", "jamnagar", "ujjain", "loni", "siliguri", "jhansi", "ulhasnagar", "nellore",
    "jammu", "sangli-miraj & kupwad", "belgaum", "mangalore", "ambattur", "tirunelveli", "malegaon", "gaya", "jalgaon", "udaipur", "maheshtala", "rangpar",
)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` names it; expressions built so grow by sums, not by products."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that the optimizer never copies into its uses: an explode of one element stands between."""
    return df.withColumn(name, F.explode(F.array(c)))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    """The first text that is neither null nor empty; the text "0" counts."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def json_text(doc: Column, key: str) -> Column:
    """A field of a variant as text."""
    return F.try_variant_get(doc, f"$.{key}", "string")


def json_truthy(doc: Column, *keys: str) -> Column:
    """The first field, as text, that is truthy: the number 0 and false are not, the text "0" is."""
    def one(key: str) -> Column:
        is_text = F.schema_of_variant(F.variant_get(doc, f"$.{key}", "variant")) == "STRING"
        may = lambda value: F.substring(value, 1, 1).isin(*"0-+. fn")  # noqa: E731  what a zero, false or null begins with; other values need no look at their type
        zero = lambda value: may(value) & ~is_text & (value.isin("false", "null") | (value.try_cast("double") == 0))
        return bound(json_text(doc, key), lambda value: F.when(value.isNotNull() & (value != "") & ~F.coalesce(zero(value), F.lit(False)), value))

    return F.coalesce(*[one(k) for k in keys])


def captured(c: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """The texts of some groups of a pattern from ^ to $ that matches ``c``, by one match for all; none of them may hold the character 1."""
    return F.split(F.regexp_replace(c, pattern + "(?s:.*)", "\x01".join(f"${i}" for i in groups)), "\x01")  # behind $ a line's end may follow


def normalize_text(c: Column) -> Column:
    return bound(F.lower(F.coalesce(c, F.lit(""))), lambda low: F.when(low == "", low).otherwise(_normalized(low)))


def _normalized(low: Column) -> Column:
    kept = F.regexp_replace(low, f"[^A-Za-z0-9_\\t\\n\\u000B\\f\\r\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]", "")
    plain = F.regexp_replace(F.regexp_replace(low, r"[^\w\s]", ""), r"\s+", " ")  # the same where all is ASCII; a long class costs a call for each of its parts and characters
    return F.btrim(F.when(F.length(low) == F.octet_length(low), plain).otherwise(F.regexp_replace(kept, f"{SPACE}+", " ")))


def number_prefix(c: Column) -> Column:
    """The number that a text begins with, null without one."""
    found = F.regexp_extract(c, rf"^{SPACE}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return bound(F.when(c.isNotNull(), found), blank_to_null).try_cast("double")


def two_decimals(value: Column) -> Column:
    """Two decimals of a double's exact binary value, ties away from zero: 1.005, which lies below, gives 1.00; from 1e13 on by its shortest decimal text.

    200 times the value is compared with the odd number between two candidates. The value is split into halves of 26 bits whose
    products are exact, so the sign of the difference is.
    """
    def cents(size: Column) -> Column:
        high = bound(size * F.lit(134217729.0), lambda scaled: scaled - (scaled - size))  # 2^27 + 1
        below = F.floor(size * 100)
        over = bound(high, lambda high: bound(below, lambda b: (high * F.lit(200.0) - (b * 2 + 1).cast("double")) + (size - high) * F.lit(200.0)))
        return below + (over >= 0).cast("long")

    def text(v: Column) -> Column:
        exact = bound(cents(F.abs(v)), lambda n: F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))
        return F.when(F.abs(v) < F.lit(1e13), exact).otherwise(F.format_string("%.2f", v))

    return bound(value, text)


def normalize_number(c: Column) -> Column:
    """Two decimals of the number in front; "0" for a null, empty or non-numeric text."""
    return F.coalesce(bound(number_prefix(c), lambda v: F.when(v.isNotNull(), two_decimals(v))), F.lit("0"))


_MONTH, _WEEKDAY = r"([A-Za-z]{3,9})\.?", r"^(?:[A-Za-z]{3,9},?\s+)?"
#: A time of day behind a date: hour, minute, half of the day and offset to UTC.
TIME = r"[T ,]+(\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\s*([AaPp][Mm])?\s*(?:Z|UTC|GMT)?([+-]\d{2}:?\d{2})?(?:\s*\([^)]*\))?$"
#: Month and day in front of the year, as numbers.
NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
#: The forms of a date, and which of their groups are year, month and day.
DATE_FORMS = {
    r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$": (1, 2, 3),
    NUMBERS: (3, 1, 2),
    _WEEKDAY + r"(\d{1,2})[ -]" + _MONTH + r"[ ,-]+(\d{4})$": (3, 2, 1),
    _WEEKDAY + _MONTH + r"[ -]+(\d{1,2}),?[ -]+(\d{4})$": (3, 1, 2),
    r"^(\d{4})[ -]" + _MONTH + r"[ -](\d{1,2})$": (1, 2, 3),
}


def normalize_date(c: Column, mode: str = "reference") -> Column:
    """yyyy-MM-dd in UTC or '': ``DATE_FORMS`` with an optional time and offset, which moves the date; a time without an offset is UTC.

    ``reference`` reads numbers in front of a year as month and day (a month past the 12th gives ''); ``dmy`` as day and month. Days up to
    the 31st run over into the next month where theirs has fewer. Names of months count by their first three letters.
    """
    number = lambda text: text.try_cast("int")
    months = F.lit("jan feb mar apr may jun jul aug sep oct nov dec")

    def parts(head: Column) -> Column:
        found = []
        for pattern, groups in DATE_FORMS.items():
            y, m, d = groups
            if mode != "reference" and pattern == NUMBERS:
                m, d = d, m
            found.append(F.when(head.rlike(pattern), bound(captured(head, pattern, (y, m, d)), lambda g: F.struct(*[F.get(g, F.lit(i)).alias(n) for i, n in enumerate("ymd")]))))
        return F.coalesce(*found)

    def minutes(t: Column) -> Column:
        half, zone = F.upper(t["half"]), t["zone"]
        hour = F.when(half == "PM", number(t["hour"]) % 12 + 12).when(half == "AM", number(t["hour"]) % 12).otherwise(number(t["hour"]))
        away = (number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, -2, 2))) * F.when(zone.startswith("-"), -1).otherwise(1)
        return F.when(hour <= 24, hour * 60 + number(t["minute"]) - F.coalesce(away, F.lit(0)))

    def date(f: Column) -> Column:
        name = F.instr(months, F.lower(F.substring(f["m"], 1, 3)))
        month = F.coalesce(number(f["m"]), F.when(name > 0, ((name - 1) / 4 + 1).cast("int")))
        first = lambda m: F.when(m.between(1, 12), F.concat(f["y"], F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-01")).try_cast("date"))  # noqa: E731  a failed cast is slow
        return F.when(number(f["d"]).between(1, 31), F.date_add(bound(month, first), number(f["d"]) - 1))

    def day(head: Column) -> Column:
        return bound(bound(head, parts), date)

    def read(clean: Column) -> Column:
        time = F.struct(*[F.regexp_extract(clean, TIME, i).alias(n) for i, n in enumerate(("hour", "minute", "half", "zone"), 1)])
        timed = F.date_add(day(F.btrim(F.regexp_replace(clean, TIME, ""))), F.floor(bound(time, minutes) / 1440).cast("int"))
        return F.when(clean != "", F.when(clean.rlike(TIME), timed).otherwise(day(clean)))

    return F.coalesce(F.date_format(bound(F.btrim(F.coalesce(c, F.lit(""))), read), "yyyy-MM-dd"), F.lit(""))


#: The fields of a fingerprint, each with the document's keys that it is taken from, in order.
FINGERPRINT_KEYS = {
    "inv": ("invoice_number", "invoice", "anchor_key"),
    "wgt": ("weight", "tonnage_tons", "weight_kg"),
    "from": ("bill_from_company_name",),
    "to": ("bill_to_company_name",),
    "date": ("invoice_date", "document_date"),
    "amt": ("total_invoice_amount", "transaction_amount", "amount"),
}


def business_fingerprint(doc: Column, date_mode: str = "reference") -> Column:
    """Six normalised fields of an extracted document (a variant), as one key; the document is computed once. Tables go through ``with_fingerprint``."""
    return bound(doc, lambda d: fingerprint_of({name: json_truthy(d, *keys) for name, keys in FINGERPRINT_KEYS.items()}, date_mode))


def fingerprint_of(fields: dict[str, Column], date_mode: str = "reference") -> Column:
    """The fingerprint of the six fields' texts."""
    norm = {"wgt": normalize_number, "amt": normalize_number, "date": lambda c: normalize_date(c, date_mode)}
    parts = [norm.get(name, normalize_text)(c) for name, c in fields.items()]
    return F.concat(*[x for name, part in zip(fields, parts, strict=True) for x in (F.lit(f"{'' if name == 'inv' else '|'}{name}:"), part)])


def with_fingerprint(df: DataFrame, json: str = "raw_json", name: str = "business_fingerprint", date_mode: str = "reference") -> DataFrame:
    """``df`` with the fingerprint of a column of JSON texts, each parsed once.

    A text that is no JSON has the empty fingerprint.
    """
    return fingerprint_of_parsed(once(df, "__doc", F.try_parse_json(json)), "__doc", name, date_mode).drop("__doc")


def fingerprint_of_parsed(df: DataFrame, doc: str, name: str = "business_fingerprint", date_mode: str = "reference") -> DataFrame:
    """``df`` with the fingerprint of a column of variants; fields are read once, then normalised."""
    fields = F.struct(*[json_truthy(F.col(doc), *keys).alias(n) for n, keys in FINGERPRINT_KEYS.items()])
    read = once(df, "__fields", fields)
    return read.withColumn(name, fingerprint_of({n: F.col("__fields").getField(n) for n in FINGERPRINT_KEYS}, date_mode)).drop("__fields")


def fingerprint_fields(fp: Column) -> Column:
    """The six fields of a fingerprint as a struct; empty ones are N/A."""
    parts = F.str_to_map(fp, F.lit("\\|"), F.lit(":"))
    return F.struct(*[first_truthy(F.element_at(parts, k), F.lit("N/A")).alias(n) for k, n in (("inv", "invoice"), ("wgt", "weight"), ("from", "bill_from"), ("to", "bill_to"), ("date", "date"), ("amt", "amount"))])


def pad3(c: Column) -> Column:
    """Zeros in front up to three characters; longer texts stay."""
    return F.when(F.length(c) < 3, F.lpad(c, 3, "0")).otherwise(c)


_FULL, _SHORT = r"^([A-Z]+)[/-]([A-Z]+)[/-](\d{2})[/-]?(\d{2})[/-](\d+)$", r"^([A-Z]+)[/-](\d{2})[/-]?(\d{2})[/-](\d+)$"


def parse_invoice_number(c: Column) -> Column:
    """struct(original, normalized, prefix, region, year, period, number); null for null or ''."""
    def made(normalized: Column, prefix: Column, region: Column, year: Column, period: Column, number: Column) -> Column:
        return F.struct(c.alias("original"), normalized.alias("normalized"), prefix.alias("prefix"), region.alias("region"), year.alias("year"), period.alias("period"), number.alias("number"))

    def known(g: Column, n: int) -> Column:
        at = [F.get(g, F.lit(i)) for i in range(n)]
        region = at[1] if n == 5 else F.lit(None).cast("string")
        return bound(pad3(at[-1]), lambda number: made(F.concat_ws("-", *at[:-1], number), at[0], region, at[-3], at[-2], number))

    def other(rest: Column) -> Column:
        return bound(F.split(rest, "-"), lambda parts: made(rest, first_truthy(F.element_at(parts, 1), F.lit("INV")), F.try_element_at(parts, F.lit(2)), F.lit("00"), F.lit("00"), pad3(F.element_at(parts, -1))))

    def read(clean: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "[^A-Z0-9]", "-"), "-+", "-"), "^-|-$", "")
        return F.when(clean.rlike(_FULL), bound(captured(clean, _FULL, (1, 2, 3, 4, 5)), lambda g: known(g, 5))).when(clean.rlike(_SHORT), bound(captured(clean, _SHORT, (1, 2, 3, 4)), lambda g: known(g, 4))).otherwise(bound(rest, other))

    return F.when(c.isNotNull() & (c != ""), bound(F.upper(F.btrim(c)), read))


def invoice_group_key(c: Column, user: Column | None = None) -> Column:
    joined = lambda p: F.concat_ws("-", *[blank_to_null(p[x]) for x in ("prefix", "region", "year", "period", "number")])
    named = c.isNotNull() & (c != "")
    key = F.when(named, bound(parse_invoice_number(c), joined)).otherwise(c)
    return key if user is None else F.when((user != "") & named, F.concat(user, F.lit(":"), key)).otherwise(key)


def same_parts(a: Column, b: Column) -> Column:
    """Whether two parsed numbers agree, a missing region standing for any."""
    region = F.coalesce(a["region"], F.lit("")).isin("") | F.coalesce(b["region"], F.lit("")).isin("") | (a["region"] == b["region"])
    return (a["normalized"] == b["normalized"]) | ((a["prefix"] == b["prefix"]) & region & (a["year"] == b["year"]) & (a["period"] == b["period"]) & (a["number"] == b["number"]))


def is_same_invoice(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & ((a == b) | same_parts(parse_invoice_number(a), parse_invoice_number(b))), F.lit(False))


def filename_doc_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("invoice"), "invoice").when(low.contains("eway") | low.contains("e way") | low.contains("e-way"), "eway").when(c.rlike(r"(?i)^[0-9]+\.?\s*[a-z]{2}\d+"), "state_doc")
        .when(low.contains("receipt"), "receipt").when(low.contains("eft"), "eft").otherwise("other")
    )


def filename_business_number(c: Column) -> Column:
    name = F.regexp_replace(c, r"\.[^.]+$", "")
    rest = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"), "_+", "_"), "^_|_$", ""))
    found = lambda p: blank_to_null(F.regexp_extract(name, p, 1))
    return F.coalesce(found(r"(?i)invoice[^0-9]*(\d+)"), found(r"(?i)e.?way[^0-9]*(\d+)"), F.upper(found(r"(?i)([A-Z]{2}\d{10,})")), found(r"(?i)(?:eft|receipt)[^0-9]*(\d+)"), rest)


def filename_fingerprint(name: Column, user: Column) -> Column:
    return F.concat_ws(":", user, filename_doc_type(name), filename_business_number(name))


def to_kg(value: Column, unit: Column) -> Column:
    """Tonnes times 1000, everything else as kilograms; null and NaN are null."""
    u = F.lower(F.btrim(F.coalesce(unit, F.lit("kg"))))
    return F.when(value.isNull() | F.isnan(value), None).when(u.isin(*TONNES), value * 1000).otherwise(value)


def to_tonnes(value: Column, unit: Column) -> Column:
    return F.when(F.lower(F.btrim(unit)) == "kg", value / 1000).otherwise(value)


def is_domestic_recycler(company: Column, words: tuple[str, ...] = DOMESTIC) -> Column:
    pattern = "|".join(w.replace(".", "\\.") for w in words)
    return F.coalesce(F.lower(company).rlike(pattern), F.lit(False))


def safe_storage_path(user: Column, name: Column, millis: Column, index: Column) -> Column:
    """The storage path of an upload; its suffix is a digest of the inputs, so a repeated job names it the same."""
    safe = F.regexp_replace(name, "[^a-zA-Z0-9.-]", "_")
    digest = F.sha2(F.concat_ws("|", user, name, millis.cast("string"), index.cast("string")), 256)
    return F.concat(F.lit("temp/"), user, F.lit("/"), F.concat_ws("_", millis.cast("string"), index.cast("string"), F.substring(digest, 1, 6), safe))


def document_view(invoice: Column, bill: Column) -> Column:
    """A reviewer's fields of an invoice and a transport bill (variants, null where absent), each the first that is truthy, else N/A."""
    first = lambda *options: F.coalesce(*options, F.lit("N/A"))
    weight = F.concat_ws(" ", json_truthy(invoice, "weight"), F.coalesce(json_truthy(invoice, "weight_unit"), F.lit("kg")))
    return F.struct(
        first(json_truthy(invoice, "invoice_number", "invoice")).alias("invoice"), first(json_truthy(invoice, "bill_to_company_name"), json_truthy(bill, "ship_to_company_name")).alias("company"),
        first(json_truthy(invoice, "bill_from_company_name"), json_truthy(bill, "ship_from_company_name")).alias("operator"), first(json_truthy(invoice, "plastic_type"), json_truthy(bill, "plastic_type")).alias("plastic"),
        first(F.when(json_truthy(invoice, "weight").isNotNull(), weight)).alias("weight"), first(json_truthy(bill, "from_location", "city"), json_truthy(invoice, "city")).alias("city"),
        first(json_truthy(bill, "ship_to_country_code", "origin_country", "country"), json_truthy(invoice, "country")).alias("country"),
    )


def plastic_label(c: Column) -> Column:
    """The label of a plastic type in any case; a type without one stays as it is."""
    out, upper = c, F.upper(c)
    for name, label in PLASTIC_LABELS.items():
        out = F.when(upper == name, label).otherwise(out)
    return out


def ui_status(table: Column, status: Column) -> Column:
    """Label of a row in the listing, by its table."""
    temp = F.when(status == "processed", "successfully_parsed").otherwise("failed_preprocessing")
    single = F.when(status.isin("processed", "skipped_duplicate"), "successfully_parsed").otherwise("failed_ai_processing")
    return F.when(table == "temp_documents", temp).when(table == "single_documents", single).otherwise("successfully_pushed_blockchain")


def retry_options(table: Column, label: Column, last_error: Column, total_pages: Column) -> Column:
    """Allowed retry actions, in order."""
    temp, single = table == "temp_documents", table == "single_documents"
    error = F.coalesce(last_error, F.lit(""))
    some = F.array_compact(F.array(
        F.when(temp & (label == "failed_preprocessing"), "force_preprocessing"), F.when(temp & (label == "successfully_parsed") & (total_pages > 1), "auto"),
        F.when(single & (label == "failed_ai_processing"), "force_ai"), F.when(single & (error.contains("duplicate") | error.contains("409")), "skip_duplicate"),
    ))
    again = (F.size(some) == 0) | label.isin("failed_preprocessing", "failed_ai_processing")
    return F.when(again, F.concat(some, F.array(F.lit("auto")))).otherwise(some)
