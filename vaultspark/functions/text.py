"""Column expressions over text, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, for the keyword index.
MARKED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

#: Wiki links, inline tags, headings.
WIKI_LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
INLINE_TAG = r"#([A-Za-z0-9_가-힣-]+)"
#: What a trim takes off: white space, no-break space and byte order mark.
BLANK = r"[\s ﻿]+"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Words of the keyword index: runs of letters and digits, lower case, without marks."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """The words of ``tokens`` as one string, with one space before, between and after them; one space without any."""
    inner = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), inner, F.lit(" ")), r"^ +| +\z|  +", " ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}|{BLANK}\z", "")


def wiki_links(content: Column) -> Column:
    """Targets of wiki links, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(WIKI_LINK), F.lit(1)), trimmed))


def inline_tags(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(INLINE_TAG), F.lit(1)))


def comma_list(text: Column, drop_empty: bool = False) -> Column:
    parts = F.transform(F.split(text, ","), trimmed)
    return F.filter(parts, lambda x: x != "") if drop_empty else parts


def base_name(path: Column) -> Column:
    """Last segment of a path without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")


def directory(path: Column) -> Column:
    """First segment of a path; a file at the root is its own directory."""
    return F.split(path, "/")[0]


def extract_date(path: Column, modified_at: Column) -> Column:
    """A date in the path (yyyy-mm-dd, else yy.mm.dd), else the day of the modification in UTC; as text, unchecked."""
    iso = F.regexp_extract(path, r"\d{4}-\d{2}-\d{2}", 0)
    dotted = r"(\d{2})\.(\d{2})\.(\d{2})"
    year = F.regexp_extract(path, dotted, 1)
    century = F.when(year >= "90", "19").otherwise("20")
    day = F.concat(century, year, F.lit("-"), F.regexp_extract(path, dotted, 2), F.lit("-"), F.regexp_extract(path, dotted, 3))
    at = F.date_format(F.timestamp_millis(modified_at), "yyyy-MM-dd")
    return F.when(iso != "", iso).when(year != "", day).otherwise(at)


def period(date: Column, granularity: str) -> Column:
    """Label of a date's day, week (weeks of seven days from 1 January) or month."""
    if granularity == "day":
        return F.date_format(date, "yyyy-MM-dd")
    if granularity == "month":
        return F.date_format(date, "yyyy-MM")
    if granularity == "week":
        week = F.floor(F.datediff(date, F.trunc(date, "YEAR")) / 7) + 1
        return F.concat(F.date_format(date, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    raise ValueError(f"granularity is day, week or month, not {granularity!r}")


def shaped(value: Column, kind: str, limit: int = 500) -> Column:
    """A cell as the table browser shows it."""
    if kind == "binary":
        return F.concat(F.lit("[BLOB "), F.octet_length(value).cast("string"), F.lit(" bytes]"))
    if kind == "string":
        return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)
    return value


def json_block(text: Column) -> Column:
    """From the first opening to the last closing brace; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def without_fence(text: Column) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(trimmed(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```\z", "")


def string_list(text: Column) -> Column:
    """A JSON list of strings; empty where it can't be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def snippet_line(text: Column, limit: int = 120) -> Column:
    return F.regexp_replace(F.substring(text, 1, limit), r"\n", " ")


def day_ms(day: Column) -> Column:
    """Milliseconds of a day's start in UTC (yyyy-mm-dd), for filters by time of change."""
    return F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86_400_000)


def percent(share: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", share * 100)
