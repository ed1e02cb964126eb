"""Shapes and masks: what may be shown of a value without showing the value."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, digits

from pyspark.sql import Column, functions as F

# White space that is trimmed, and digits beyond \p{Nd} (superscripts, circled forms).
_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_OTHER_DIGITS = (
    r"²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼"
    r"⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
_EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_DATE = r"(?U)^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.trim(text, F.lit(_SPACE))


def _shape(text: Column) -> Column:
    """Letters to A and digits to 9: ASCII by a lookup, the rest by character class."""
    plain = F.translate(text, ascii_letters + digits, "A" * len(ascii_letters) + "9" * len(digits))
    letters = F.regexp_replace(plain, r"[[^\x00-\x7f]&&\p{L}]", "A")
    rest = F.regexp_replace(letters, rf"[[^\x00-\x7f]&&[\p{{Nd}}{_OTHER_DIGITS}]]", "9")
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(rest)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a body that names it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_runs(template: Column) -> Column:
    """Write a run of five or more equal characters (line breaks excepted) as X{n}.

    The template's only letter is A, so another letter can mark where runs begin and end.
    """
    marked = F.regexp_replace(template, r"([^\n])\1{4,}", "Z$0Z")

    def piece(p: Column, i: Column) -> Column:
        folded = F.concat(F.left(p, F.lit(1)), F.lit("{"), F.length(p).cast("string"), F.lit("}"))
        return F.when(i % 2 == 1, folded).otherwise(p)

    return F.array_join(F.transform(F.split(marked, "Z"), piece), "")


def _is_email(value: Column) -> Column:
    # what is cheap to see is asked before the expression, which most values need not meet
    return F.contains(value, F.lit("@")) & value.rlike(_EMAIL)


def _is_date(value: Column) -> Column:
    return F.length(value).isin(10, 16, 19) & value.rlike(_DATE)


def structural_pattern(text: Column) -> Column:
    """'SKU-001' -> 'AAA-999'; 'empty', 'email', 'uuid' and 'date' are named; runs are folded."""

    def pattern(value: Column) -> Column:
        return (
            F.when(value == "", "empty")
            .when(_is_email(value), "email")
            .when((F.length(value) == 36) & value.rlike(_UUID), "uuid")
            .when(_is_date(value), "date")
            .otherwise(_fold_runs(_shape(value)))
        )

    return _once(strip(text), pattern)


def _edge(part: Column) -> Column:
    return (
        F.when(F.length(part) == 0, "")
        .when(F.length(part) == 1, "*")
        .otherwise(F.concat(F.substring(part, 1, 1), F.lit("***")))
    )


def mask_value(text: Column) -> Column:
    """First and last character around stars; e-mail addresses keep their form and last label."""

    def mask(value: Column) -> Column:
        local = F.substring_index(value, "@", 1)
        domain = F.substring_index(value, "@", -1)
        label = F.substring_index(domain, ".", -1)
        host = F.left(domain, F.length(domain) - F.length(label) - 1)
        address = F.concat(_edge(local), F.lit("@"), _edge(host), F.lit("."), label)
        size = F.length(value)
        stars = F.repeat(F.lit("*"), size - 2)
        return (
            F.when(_is_email(value), address)
            .when(size <= 2, F.repeat(F.lit("*"), size))
            .otherwise(F.concat(F.left(value, F.lit(1)), stars, F.right(value, F.lit(1))))
        )

    return _once(strip(text), mask)


def redact_text(text: Column) -> Column:
    """Mask addresses inside free text, and put <number> for long digit runs; short codes stay."""
    local, host, label = "[A-Za-z0-9._%+-]", "[A-Za-z0-9.-]", "[A-Za-z]{2,}"
    # A part of one character is masked whole, so the four length cases are replaced in turn.
    masked = text
    for pattern, replacement in (
        (rf"({local}){local}+@({host}){host}+\.({label})", "$1***@$2***.$3"),
        (rf"({local}){local}+@{host}\.({label})", "$1***@*.$2"),
        (rf"{local}@({host}){host}+\.({label})", "*@$1***.$2"),
        (rf"{local}@{host}\.({label})", "*@*.$1"),
    ):
        masked = F.regexp_replace(masked, pattern, replacement)
    value = F.coalesce(text, F.lit(""))
    masked = F.when(F.contains(value, F.lit("@")), masked).otherwise(value)
    return F.regexp_replace(masked, r"(?U)\b\d[\d -]{5,}\d\b", "<number>")


def message_template(text: Column) -> Column:
    """A redacted message with its remaining numbers and spacing levelled: one text per cause."""
    numbered = F.regexp_replace(redact_text(text), r"\d+", "<n>")
    return F.trim(F.regexp_replace(numbered, r"\s+", " "))
