"""Codes, labels, names and stamps as Column expressions (STR, PRD, PRJ, DAT, ARR operators)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "BLANK"
_MAX = 2**63 - 1


def natural_key(code: Column) -> Column:
    """SRT-02: first character, the digit run after it (none: largest), the code itself."""
    digits = F.regexp_extract(code, r"^.([0-9]+)", 1)
    return F.struct(F.substring(code, 1, 1).alias("head"), F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(_MAX)).alias("number"), code.alias("code"))


def display_key(code: Column) -> Column:
    """SRT-03: BLANK last, else case-insensitive letters, then number, then the code (ASCII letters and digits)."""
    number = F.regexp_extract(code, r"([0-9]+)", 1)
    return F.struct((code == BLANK).alias("last"), F.lower(F.regexp_extract(code, r"^([^0-9]*)", 1)).alias("head"), F.coalesce(F.when(number != "", number.try_cast("bigint")), F.lit(-1)).alias("number"), code.alias("code"))


def effective_code(code: Column, corrected: Column) -> Column:
    """PRJ-06."""
    return F.coalesce(corrected, code)


def parse_codes(text: Column) -> Column:
    """PRJ-08, ARR-02: comma list to sorted upper-case codes; blank text gives NULL."""
    parts = F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x)))
    return F.when(F.trim(text) != "", F.array_sort(F.filter(parts, lambda x: x != "")))


def bad_codes(codes: Column) -> Column:
    """PRD-05, PRD-06: every offender of the code format."""
    return F.filter(codes, lambda x: ~x.rlike(r"^[A-Za-z][0-9]{1,3}$"))


def is_closed_code(code: Column) -> Column:
    """PRD-13: a letter and digits only."""
    return code.rlike(r"^[A-Za-z][0-9]+$")


def is_supported_code(code: Column) -> Column:
    """PRD-14."""
    return (code == BLANK) | is_closed_code(code)


def correction_allowed(code: Column, valid: Column) -> Column:
    """PRD-08, PRD-21: at most eight bytes and BLANK or a valid code."""
    return (F.octet_length(code) <= 8) & ((code == BLANK) | F.array_contains(valid, code))


def normalize_hex(hex_: Column) -> Column:
    """PRD-19: '#RRGGBB' in capitals, NULL if it isn't six hex digits."""
    digits = F.regexp_extract(F.trim(hex_), r"^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(digits != "", F.concat(F.lit("#"), F.upper(digits)))


def accept(code: Column, known: Column, confidence: Column, least: float) -> Column:
    """PRD-15: the code, or UNKNOWN."""
    return F.when(known & (confidence >= least), code).otherwise("UNKNOWN")


def progress_percent(done: Column, total: Column) -> Column:
    """PRJ-09."""
    return F.coalesce(F.least(F.lit(100.0), F.try_divide(done * 100.0, total)), F.lit(0.0))


def search_prefix(code: Column, prefix: str, wildcards: bool = True) -> Column:
    """PRD-03: case-insensitive prefix; ``wildcards`` leaves % and _ of the input active, as the original does."""
    return F.upper(code).like(prefix.upper() + "%") if wildcards else F.upper(code).startswith(prefix.upper())


def sanitize_filename(name: Column) -> Column:
    """STR-01."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def _stem(name: Column, first_dot: bool = False) -> Column:
    return F.regexp_extract(name, r"^([^.]*)", 1) if first_dot else F.regexp_replace(name, r"\.[^.]*$", "")


def label_of(name: Column, first_dot: bool = False) -> Column:
    """STR-02, STR-03: label of a cell file name; NULL if it holds none."""
    stem = F.upper(_stem(name, first_dot))
    t = F.split(stem, "_")
    head, third = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(3))
    return (
        F.when(stem.rlike("^(BLANK|EMPTY)(_|$)"), BLANK)
        .when(head.rlike("^R[0-9]+$") & F.try_element_at(t, F.lit(2)).rlike("^C[0-9]+$") & third.isNotNull(), third)
        .when(head.rlike("^[A-Z]"), head)
    )


def code_from_filename(name: Column) -> Column:
    """STR-04: as label_of, also sample_N_CODE; a code needs a letter and a digit."""
    stem = F.upper(_stem(name))
    t = F.split(stem, "_")
    third = F.try_element_at(t, F.lit(3))
    code = F.when(F.try_element_at(t, F.lit(1)) == "SAMPLE", third).otherwise(label_of(name))
    return F.when((code == BLANK) | code.rlike("^[A-Z]+[0-9]+$"), code)


def answer_code(text: Column) -> Column:
    """STR-05: code from a model's answer: prefix off, cut at line end, dot, comma or space, allow-list, anchored match."""
    cut = F.regexp_extract(F.regexp_replace(F.trim(text), r"(?i)^(the code is|code|answer)\s*[:=]?\s*", ""), r"^([^\n., ]*)", 1)
    code = F.regexp_extract(F.upper(F.regexp_replace(cut, r"[^A-Za-z0-9]", "")), r"^([A-Z][0-9]{1,3})", 1)
    return F.nullif(code, F.lit(""))


def region_triples(text: Column) -> Column:
    """STR-06: array of (row, col, token) of all R#C#=token marks."""
    found = F.regexp_extract_all(text, F.lit(r"(R[0-9]+C[0-9]+=[A-Za-z0-9]+)"), 1)
    part = lambda x, p, k: F.regexp_extract(x, p, k)
    return F.transform(found, lambda x: F.struct(part(x, r"R([0-9]+)C", 1).cast("int").alias("row"), part(x, r"C([0-9]+)=", 1).cast("int").alias("col"), F.upper(part(x, r"=(.+)$", 1)).alias("token")))


def export_name(code: Column, row: Column, col: Column, hue: Column, brightness: Column) -> Column:
    """STR-07; rows and columns count from 1 in names."""
    return F.format_string("%s_r%d_c%d_h%d_v%d.png", code, row + 1, col + 1, hue, brightness)


def board_cell_name(code: Column, row: Column, col: Column) -> Column:
    """STR-08."""
    return F.format_string("r%03d_c%03d_%s.png", row, col, code)


def token_indices(code: Column, vocabulary: list[str]) -> Column:
    """STR-09, with -1 for an unknown character."""
    at = F.create_map(*[x for i, c in enumerate(vocabulary) for x in (F.lit(c), F.lit(i))])
    return F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(at, c), F.lit(-1)))


def pad(indices: Column, size: int) -> Column:
    """ARR-06: pad by -1 to a length."""
    return F.slice(F.concat(indices, F.array_repeat(F.lit(-1), size)), 1, size)


def joined_hash(codes: Column) -> Column:
    """STR-10: sha256 of the entries joined by '|'."""
    return F.sha2(F.array_join(codes, "|").cast("binary"), 256)


def iso_stamp(ts: Column) -> Column:
    """DAT-01."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_stamp(text: Column) -> Column:
    """DAT-02; what can't be read is NULL."""
    return F.try_to_timestamp(text)


def date_stamp(ts: Column) -> Column:
    """DAT-03."""
    return F.date_format(ts, "yyyyMMdd")


def version_stamp(ts: Column) -> Column:
    """DAT-04."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def is_terminal(status: Column) -> Column:
    """PRD-22."""
    return status.isin("SUCCEEDED", "SUCCEEDED_WITH_WARNINGS", "FAILED")


def next_version(names: Column, pattern: str, prefix: str) -> Column:
    """STR-18, AGG-31: aggregate; the name after the largest number in use."""
    return F.concat(F.lit(prefix), (F.coalesce(F.max(F.regexp_extract(names, pattern, 1).try_cast("bigint")), F.lit(0)) + 1).cast("string"))


def result_row(code: Column, confidence: Column) -> tuple[Column, Column]:
    """PRJ-07: code in capitals, confidence at four places."""
    return F.upper(code), F.round(confidence, 4)


def render_code(code: Column, brand: Column, prefixes: dict[str, str]) -> Column:
    """PRJ-10: the code as printed: without the prefix that tells its brand's codes apart in the library."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair]), brand)
    return F.when(prefix.isNotNull() & code.startswith(prefix), F.substr(code, F.length(prefix) + 1)).otherwise(code)
