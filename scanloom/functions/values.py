"""Values as the scanner writes them, as typed columns: lists in text, places, sizes, durations, levels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {"高危": "high", "高": "high", "high": "high", "中危": "medium", "中": "medium", "medium": "medium", "低危": "low", "低": "low", "low": "low"}


def text_list(col: Column) -> Column:
    """A list written as text in either quote style; null if it isn't one."""
    return F.from_json(F.translate(col, "'", '"'), "array<string>")


def lines_of(location: Column) -> Column:
    """A place, "12" or "[3, 5]", as an array of its numbers; null if it has none."""
    numbers = F.transform(F.regexp_extract_all(location, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(numbers) > 0, numbers)


def spread_range(location: Column) -> Column:
    """"[3, 5]" as "3, 4, 5" and "12" as "12"; a range that runs backwards is read forwards; null stays null."""
    n = lines_of(location)
    return F.when(n.isNotNull(), F.array_join(F.sequence(F.array_min(n), F.array_max(n)), ", "))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, such as the 28800 of "28800 行"."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(\d+)", 1), F.lit("")).cast("bigint")


def size_in_bytes(text: Column) -> Column:
    """"12.3 KB" as bytes."""
    number = F.nullif(F.regexp_extract(text, r"^\s*([0-9.]+)", 1), F.lit("")).cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMGT]?B)\s*$", 1))
    power = F.when(unit == "KB", 1).when(unit == "MB", 2).when(unit == "GB", 3).when(unit == "TB", 4).otherwise(0)
    return F.round(number * F.pow(F.lit(1024.0), power)).cast("bigint")


def readable_size(size: Column) -> Column:
    """Bytes with the largest unit of which there is one at least, one digit after the point: 1536 as "1.5 KB"."""
    step = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    return F.concat(F.round(size / F.pow(F.lit(1024.0), step), 1).cast("string"), F.lit(" "), unit)


def duration_text(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds; days count as hours."""
    s = seconds.cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("时"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.lit("分"), F.pmod(s, F.lit(60)).cast("string"), F.lit("秒"))


def level_code(level: Column, unknown: str | None = "high") -> Column:
    """A level in any of its spellings as high, medium or low; what is unknown or null as `unknown`."""
    name = F.lower(F.trim(level))
    code = F.when(F.lit(False), F.lit(""))
    for spelt, en in LEVELS.items():
        code = code.when(name == spelt, F.lit(en))
    return code.otherwise(F.lit(unknown))


def padded_cwe(number: Column) -> Column:
    """A weakness number of two digits with a leading zero; others as they are."""
    return F.when(F.length(number) == 2, F.concat(F.lit("0"), number)).otherwise(number)


#: Names of the weaknesses that rules speak of: fixed values.
WEAKNESSES = {
    "22": "Path Traversal", "78": "OS Command Injection", "79": "Cross-site Scripting", "89": "SQL Injection", "90": "LDAP Injection", "91": "XML Injection",
    "93": "CRLF Injection", "94": "Code Injection", "99": "Resource Injection", "15": "External Control of Setting", "16": "Configuration", "200": "Information Exposure", "113": "HTTP Response Splitting", "117": "Log Injection", "120": "Classic Buffer Overflow", "134": "Format String",
    "235": "Extra Parameters", "259": "Hard-coded Password", "295": "Improper Certificate Validation", "327": "Broken Cryptography", "330": "Insufficient Randomness",
    "352": "Cross-Site Request Forgery", "400": "Resource Consumption", "489": "Active Debug Code", "502": "Unsafe Deserialization", "601": "Open Redirect",
    "611": "XML External Entity", "614": "Cookie Without Secure", "643": "XPath Injection", "798": "Hard-coded Credentials", "918": "Server-Side Request Forgery",
    "346": "Origin Validation Error", "348": "Less Trusted Source", "434": "Unrestricted Upload", "481": "Assigning Instead of Comparing", "540": "Source Code Exposure",
    "652": "XQuery Injection", "704": "Incorrect Conversion", "710": "Coding Standard", "732": "Incorrect Permission", "776": "XML Entity Expansion", "917": "Expression Language Injection",
    "942": "Permissive Cross-domain Policy", "943": "NoSQL Injection", "1236": "Formula Injection",
    "1004": "Cookie Without HttpOnly", "1336": "Template Injection",
}


def weakness_name(number: Column) -> Column:
    """The name of a weakness by its number, null if it isn't known."""
    return F.create_map(*[F.lit(x) for pair in WEAKNESSES.items() for x in pair])[F.regexp_replace(number, "^0+", "")]


def ascii_punctuation(text: Column) -> Column:
    """Full-width punctuation as ASCII, backslashes as slashes."""
    return F.translate(text, "（），；：“”‘’！？【】《》。\\", "(),;:\"\"''!?[]<>./")


def without_comments(code: Column) -> Column:
    """Code of the C family without comments, imports and blank lines."""
    plain = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
    plain = F.regexp_replace(plain, r"//[^\n]*", "")
    plain = F.regexp_replace(plain, r"(^|\n)[ \t\r\f]*(?:import|package|#include|using)\b[^\n]*", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"\n\s*\n", "\n"), r"^\s+|\s+$", "")


def in_order(text: Column, words: list[str]) -> Column:
    """Whether the words stand in the text one after the other."""
    return text.rlike("(?s)" + ".*".join(re.escape(w) for w in words))


def mode_of_scan(kind: Column) -> Column:
    """How a task was scanned, from its list of detectors: thinking, fast or careful."""
    parts = text_list(kind)
    return F.when(F.array_contains(parts, "r4"), "thinking").when(F.get(parts, F.lit(1)) == "false", "fast").when(parts.isNotNull(), "careful")
