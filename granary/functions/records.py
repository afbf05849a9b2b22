"""Access to the fields of a record: keys, labels, files, links, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import year_in

# Endings and type prefixes by kind of file.
FILE_KINDS = {"PDF": ("pdf",), "Video": ("mp4", "mov", "avi", "mkv", "webm"), "Audio": ("mp3", "wav", "ogg", "m4a"), "Image": ("png", "jpg", "jpeg", "gif", "tif", "tiff", "webp", "svg")}


def filled(text: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(text), F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def record_key(row_id: Column, mongo_id: Column, link: Column) -> Column:
    """The original id, else the internal one, else the link."""
    return first_filled(row_id, mongo_id, link)


def safe_key(row_id: Column, link: Column, title: Column, created: Column) -> Column:
    """The original id, else the first 24 signs of the digest of the link, else of title and creation."""
    digest = lambda c: F.substring(F.md5(c), 1, 24)
    return F.coalesce(filled(row_id), digest(filled(link)), digest(F.concat(F.coalesce(title, F.lit("")), F.lit("-"), F.coalesce(created, F.lit("")))))


def primary_language(labels: Column) -> Column:
    return F.coalesce(filled(F.lower(F.get(labels, F.lit(0)))), F.lit("unknown"))


def licence_norm(licence: Column) -> Column:
    """Upper case, the long name of the common licences short, separators one blank."""
    up = F.upper(F.coalesce(licence, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(up, "CREATIVE COMMONS", "CC"), r"[\s_\-]+", " "))


def extension(own: Column, name: Column, url: Column) -> Column:
    """Lower-case ending without a dot: the field, else of the file name, else of the link's path."""
    of = lambda c: F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1)), F.lit(""))
    given = F.nullif(F.lower(F.regexp_replace(F.trim(F.coalesce(own, F.lit(""))), r"^\.", "")), F.lit(""))
    return F.coalesce(given, of(name), of(url))


def file_kind(mime: Column, ending: Column) -> Column:
    """PDF, Video, Audio, Image, Other, or Unknown without type and ending."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    out = F.when((m == "") & ending.isNull(), "Unknown")
    for kind, endings in FILE_KINDS.items():
        is_kind = m == "application/pdf" if kind == "PDF" else F.startswith(m, F.lit(f"{kind.lower()}/"))
        out = out.when(is_kind | F.coalesce(ending.isin(*endings), F.lit(False)), kind)
    return out.otherwise("Other")


def link(url: Column) -> Column:
    """A link with a scheme; null for a blank one."""
    u = filled(url)
    return F.when(F.regexp_like(u, F.lit("(?i)^https?://")), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(link(url), r"(?i)^https?://([^/:?#\s]+)", 1)), r"^www\.", ""), F.lit(""))


def under_hosts(url: Column, hosts: list[str]) -> Column:
    """Whether the host is one of these or below one of them."""
    h = host(url)
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in hosts]), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x))), F.lit(False))


def is_doi(doi: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(doi), F.lit(r"^10\.[0-9]{4,9}/\S+$")), F.lit(False))


def any_date(text: Column) -> Column:
    """The day of a date in one of the usual forms; null for none."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
    dotted = F.regexp_replace(t, r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$", "$3-$2-$1")
    padded = F.concat_ws("-", F.split_part(dotted, F.lit("-"), F.lit(1)), F.lpad(F.split_part(dotted, F.lit("-"), F.lit(2)), 2, "0"), F.lpad(F.split_part(dotted, F.lit("-"), F.lit(3)), 2, "0"))
    return F.coalesce(iso, F.when(dotted != t, padded.try_cast("date")))


__all__ = ["filled", "first_filled", "record_key", "safe_key", "primary_language", "licence_norm", "extension", "file_kind", "link", "host", "under_hosts", "is_doi", "any_date", "year_in"]
