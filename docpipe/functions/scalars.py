"""String, date, JSON and id expressions. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from docpipe.schemas import DEFAULT_RATE_LIMITS, ROLE_PERMISSIONS

# The code points str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ID_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def strip_text(text: Column) -> Column:
    """Python's ``str.strip``. A trim over a character set only touches the
    ends of the text, where a regular expression would scan all of it."""
    return F.trim(text, F.lit(WHITESPACE))


def rstrip_text(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS…`` to a naive timestamp; the zone suffix is ignored
    and anything malformed is null."""
    digits = F.substring(F.regexp_replace(raw, "^D:", ""), 1, 14)
    iso = F.regexp_replace(
        digits, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"
    )
    well_formed = digits.rlike(r"^\d{14}$") & ~digits.startswith("0000")
    return F.when(well_formed, iso.try_cast("timestamp_ntz"))


def iso_format(ts: Column) -> Column:
    """ISO 8601 without a fraction for whole seconds, else six digits."""
    text = F.translate(ts.cast("timestamp_ntz").cast("string"), " ", "T")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def parse_sidecar(text: Column) -> Column:
    """``key=value`` lines to a map; the last value of a repeated key wins and
    keeps the place of the first one."""
    lines = F.filter(F.split(strip_text(text), "\n"), lambda x: F.contains(x, F.lit("=")))
    keys = F.transform(lines, lambda x: F.substring_index(x, "=", 1))

    def last_value(key: Column) -> Column:
        line = F.element_at(F.filter(lines, lambda x: x.startswith(F.concat(key, F.lit("=")))), -1)
        return F.substr(line, F.length(key) + F.lit(2))

    unique = F.array_distinct(keys)
    return F.map_from_arrays(unique, F.transform(unique, last_value))


def render_sidecar(metadata: Column) -> Column:
    entries = F.map_entries(metadata)
    return F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), "\n")


def map_as_text(mapping: Column) -> Column:
    """Key-ordered ``k=v`` list: a map in a form other engines can compare."""
    entries = F.array_sort(F.map_entries(mapping))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ";"
    )


def parse_job_options(options: Column) -> Column:
    parsed = F.from_json(options, "output_format string, extractor string, include_metadata boolean")
    return F.struct(
        F.coalesce(parsed.output_format, F.lit("markdown")).alias("output_format"),
        F.coalesce(parsed.extractor, F.lit("pdfplumber")).alias("extractor"),
        F.coalesce(parsed.include_metadata, F.lit(True)).alias("include_metadata"),
    )


def mask_token(token_id: Column) -> Column:
    return F.concat(F.substring(token_id.cast("string"), 1, 8), F.lit("..."))


def blob_url(name: Column, scheme: str = "file", **location: str) -> Column:
    """Public URL of a blob. ``file`` needs ``base``, ``s3`` needs ``bucket``
    and ``region``, ``azure`` needs ``account`` and ``container``, ``gcs``
    needs ``bucket``."""
    if scheme == "file":
        prefix = f"file://{location.get('base', '').rstrip('/')}/"
    elif scheme == "s3":
        prefix = f"https://{location['bucket']}.s3.{location['region']}.amazonaws.com/"
    elif scheme == "azure":
        prefix = f"https://{location['account']}.blob.core.windows.net/{location['container']}/"
    elif scheme == "gcs":
        prefix = f"https://storage.googleapis.com/{location['bucket']}/"
    else:
        raise ValueError(f"Unknown blob storage provider: {scheme}")
    return F.concat(F.lit(prefix), name)


def role_limit(role: Column) -> Column:
    """Default requests per minute of a role."""
    rule = F.lit(None).cast("int")
    for name, limit in DEFAULT_RATE_LIMITS.items():
        rule = F.when(role == name, F.lit(limit)).otherwise(rule)
    return rule


def has_permission(role: Column, permission: str) -> Column:
    """Whether a role holds one named permission; an unknown role holds none."""
    holders = [name for name, granted in ROLE_PERMISSIONS.items() if permission in granted]
    return F.coalesce(role.isin(*holders), F.lit(False))


def hash_id(*parts: Column, length: int = 10) -> Column:
    """Base-62 id from the first 60 bits of a SHA-256 over the parts: the same
    input gives the same id when a task is retried."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    base = len(ID_ALPHABET)
    digits = [F.substr(F.lit(ID_ALPHABET), _digit(number, base, i), F.lit(1)) for i in range(length)]
    return F.concat(*digits)


def _digit(number: Column, base: int, position: int) -> Column:
    """1-based alphabet index of one base-62 digit (exact integer division)."""
    shifted = F.call_function("div", number, F.lit(base**position)) if position else number
    return (F.pmod(shifted, F.lit(base)) + 1).cast("int")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 on the timestamp's own wall clock. Built from
    date and time fields, so the session time zone cannot reorder it."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return seconds * 60_000_000 + fraction


def floor_div(number: Column, divisor: int) -> Column:
    """Exact integer division rounding down, for negatives as well."""
    return F.call_function("div", number - F.pmod(number, F.lit(divisor)), F.lit(divisor))


def as_timestamp(value) -> Column:
    """A naive timestamp literal from text, datetime or an existing column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")
