"""SQL fragments the oracle queries share."""

from docpipe.functions.scalars import ID_ALPHABET

AS_OF = "2024-01-15 00:00:00"
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31))"
MAX_MB = 0.01


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def iso(expr: str) -> str:
    return (
        f"CASE WHEN microsecond({expr}) % 1000000 = 0 THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def hash_id(*parts: str) -> str:
    text = f"concat_ws('|', {', '.join(f'coalesce(CAST({p} AS VARCHAR), {chr(39)*2})' for p in parts)})"
    number = f"CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)"
    digits = " || ".join(
        f"substr('{ID_ALPHABET}', CAST(({number} // {62**i}) % 62 + 1 AS INT), 1)" for i in range(10)
    )
    return f"({digits})"


def file_error(max_mb: float = MAX_MB) -> str:
    limit = int(max_mb * 1024 * 1024)
    return f"""CASE WHEN strlen(body) = 0 THEN 'File is empty'
  WHEN strlen(body) > {limit} THEN concat('File too large: ',
       printf('%.1f', CAST(round_even(strlen(body) / 1048576.0, 1) AS DOUBLE)), ' MB (max: {max_mb:g} MB)')
  WHEN left(body, 5) <> '%PDF-' THEN 'File is not a valid PDF (invalid signature)' ELSE '' END"""


def page_list(text: str, n: int = 5) -> str:
    lines = f"string_split({text}, chr(10))"
    return (
        f"list_transform(range(0, (len({lines}) - 1) // {n} + 1), "
        f"lambda p: array_to_string({lines}[p * {n} + 1 : p * {n} + {n}], chr(10)))"
    )


def shown_text(pages: str) -> str:
    stripped = f"list_transform({pages}, lambda t: {strip('t')})"
    return f"array_to_string(list_filter({stripped}, lambda t: t <> ''), chr(10) || chr(10))"


def words(text: str) -> str:
    return rf"CAST(len(regexp_extract_all({text}, '\S+')) AS BIGINT)"


ENTRIES_TEXT = "array_to_string(list_transform(list_sort(map_keys({m})), lambda k: concat(k, '=', {m}[k])), ';')"


def map_text(m: str) -> str:
    return ENTRIES_TEXT.replace("{m}", m)
