"""Texts of queries, prompts and replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.vector import as_column

#: Characters of a query that are used.
QUERY_CHARS = 15_000
PREVIEW_CHARS = 80


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(as_column(text), r"^\s+|\s+$", "")


def normalised_query(text: Column | str, chars: int = QUERY_CHARS) -> Column:
    return F.substring(trimmed(text), 1, chars)


def document_text(name: Column | str, description: Column | str) -> Column:
    """Name and description on lines of their own; a null part is left out."""
    return F.concat_ws("\n", as_column(name), as_column(description))


def numbered(texts: Column | str) -> Column:
    """``"0. first\\n1. second"`` of an array of texts; null texts read empty."""
    return F.array_join(F.transform(as_column(texts), lambda t, i: F.concat(i.cast("string"), F.lit(". "), F.coalesce(t, F.lit("")))), "\n")


def filled(template: Column | str, topic: Column | str, mark: str = "{topic}") -> Column:
    """A prompt template with its topic; other braces stay as they are."""
    return F.replace(as_column(template), F.lit(mark), as_column(topic))


def without_space(reply: Column | str) -> Column:
    return F.regexp_replace(as_column(reply), r"\s", "")


def digit_verdicts(reply: Column | str, n: Column | int) -> Column:
    """Verdicts of a reply of exactly ``n`` digits 0 or 1, white space aside; null for any other reply."""
    digits = without_space(reply)
    n = F.lit(n) if isinstance(n, int) else n
    fine = (F.length(digits) == n) & digits.rlike("^[01]+$")
    return F.when(fine, F.transform(F.split(digits, ""), lambda c: c == "1"))


def title_lines(reply: Column | str, n: Column | int) -> Column:
    """The lines of a reply that are not blank, trimmed; null if there are fewer than ``n - 1``."""
    lines = F.filter(F.transform(F.split(as_column(reply), "\n"), trimmed), lambda x: x != "")
    return F.when(F.size(lines) >= (F.lit(n) if isinstance(n, int) else n) - 1, lines)


def json_verdicts(reply: Column | str, n: Column | int) -> Column:
    """Verdicts of a JSON list of exactly ``n`` booleans; null for any other reply."""
    got = F.from_json(trimmed(reply), "array<boolean>")
    return F.when((F.size(got) == n) & ~F.exists(got, lambda x: x.isNull()), got)


def preview(text: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    return F.concat(F.substring(as_column(text), 1, chars), F.lit("..."))


def either_timestamp(text: Column | str) -> Column:
    """A timestamp written with a space or with a T between date and time; null if neither."""
    spaced = F.regexp_replace(trimmed(text), "T", " ")
    return F.when(spaced.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.to_timestamp(spaced, "yyyy-MM-dd HH:mm:ss"))
