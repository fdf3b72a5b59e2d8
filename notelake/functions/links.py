"""Wikilinks as columns: a link is [[path]] or [[path|alias]]; the last two parts of the path are folder and record."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a link looks like.
WIKILINK = r"^\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]$"
_LINK = re.compile(WIKILINK)


def parse(text: str) -> tuple[str | None, str] | None:
    """(folder, name) of a link in Python; folder is None for a one-part path; None for other text."""
    found = _LINK.match(text.strip()) if isinstance(text, str) else None
    if not found:
        return None
    *rest, name = [p.strip() for p in found[1].split("/")]
    return (rest[-1] if rest else None), name


def is_link(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(WIKILINK), F.lit(False))


def _parts(value: Column) -> Column:
    path = F.nullif(F.regexp_extract(F.trim(value), WIKILINK, 1), F.lit(""))
    return F.split(path, "/")


def link_name(value: Column) -> Column:
    """The record that a link names; null for other text."""
    return F.trim(F.try_element_at(_parts(value), F.lit(-1)))


def link_folder(value: Column) -> Column:
    """The folder, that is the type, of a link; null for a one-part path or other text."""
    return F.trim(F.try_element_at(_parts(value), F.lit(-2)))


def shown(value: Column) -> Column:
    """How a link comes out in a table: the record's name; other text as it is."""
    return F.coalesce(link_name(value), value)


def as_link(folder: Column, name: Column) -> Column:
    return F.concat(F.lit("[["), folder, F.lit("/"), name, F.lit("]]"))
