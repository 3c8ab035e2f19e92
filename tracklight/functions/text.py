"""Text functions of titles, paths, bodies and custom values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Markdown that a preview leaves out, pattern and what takes its place, in order. Underscores and list numbers stay.
PREVIEW = (
    (r"(?s)```.*?```", " "),
    (r"`([^`]*)`", "$1"),
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]*[#>\-*+]+[ \t]+", ""),
    (r"[*~]", ""),
)


def preview(body: Column | str, most: int = 240) -> Column:
    """A note's body as one plain line of up to `most` characters."""
    plain = reduce(lambda t, p: F.regexp_replace(t, *map(F.lit, p)), PREVIEW, _col(body))
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, most)


def truncate(text: Column | str, most: int) -> Column:
    """With an ellipsis in the last place where it is too long."""
    text = _col(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def sanitize_name(title: Column | str, most: int = 60) -> Column:
    """A title as a file name: marks that file systems mind become dashes; of `most` characters the points and spaces at the end go."""
    name = F.regexp_replace(_col(title), r'[\\/:*?"<>|#^\[\]]', "-")
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.regexp_replace(F.substring(name, 1, most), r"[. ]+$", "")


def slug(text: Column | str) -> Column:
    """Lower case, trimmed, runs of white space as single dashes; all else stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"^\s+|\s+$", ""), r"\s+", "-")


def initials(name: Column | str) -> Column:
    """First letters of the first and second word, or the first two characters where there is one word, in upper case."""
    words = F.filter(F.split(_col(name), r"\s+"), lambda w: w != "")
    two = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1))
    return F.upper(F.when(F.size(words) >= 2, two).otherwise(F.substring(_col(name), 1, 2)))


def link_name(reference: Column | str) -> Column:
    """What a wiki link shows: its alias, or the last part of its path without the heading."""
    inner = F.regexp_replace(F.trim(_col(reference)), r"^\[\[|\]\]$", "")
    target = F.regexp_replace(F.split(F.split(inner, r"\|").getItem(0), "#").getItem(0), r"^.*/", "")
    return F.when(inner.contains("|"), F.element_at(F.split(inner, r"\|"), -1)).otherwise(F.regexp_replace(target, r"\.md$", ""))


def link_target(reference: Column | str) -> Column:
    """The path that a wiki link points to."""
    inner = F.regexp_replace(F.trim(_col(reference)), r"^\[\[|\]\]$", "")
    return F.trim(F.split(F.split(inner, r"\|").getItem(0), "#").getItem(0))


def hue(text: Column | str) -> Column:
    """0 to 359 from a text's characters, by a 32-bit rolling hash."""
    wrap = lambda x: F.pmod(x + 2**31, F.lit(2**32)) - 2**31
    step = lambda h, c: F.ascii(c).cast("long") + wrap(wrap(h) * 32) - h
    total = F.aggregate(F.split(_col(text), ""), F.lit(0).cast("long"), step)
    return F.abs(total) % 360


def custom_text(value: Column | str) -> Column:
    """A custom value as text: lists joined by commas, null as ''."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(_col(value), r'^\["?|"?\]$', ""), r'"?,\s*"?', ", "), F.lit(""))


def embedded_in_archive(path: Column | str) -> Column:
    return _col(path).rlike(r"(^|/)Archive/")


def task_folder(project_path: Column | str) -> Column:
    """Where a project's case files are.

    Beside a note in a folder of its own name, `Tasks`; of a note in a folder's `Cases`, that folder's `Tasks` and the note's name; else `NAME_tasks`.
    """
    path = _col(project_path)
    own = path.rlike(r"^(?:.*/)?([^/]+)/\1\.md$")
    shared = r"^(.*)/Cases/([^/]+)\.md$"
    beside = F.when(path.rlike(shared), F.regexp_replace(path, shared, "$1/Tasks/$2")).otherwise(F.regexp_replace(path, r"\.md$", "_tasks"))
    return F.when(own, F.regexp_replace(path, r"[^/]+\.md$", "Tasks")).otherwise(beside)
