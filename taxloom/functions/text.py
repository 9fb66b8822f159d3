"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what is left of them.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def once(c: Column) -> Column:
    """The same value from a generator: filters of later steps don't move below it with a copy of the expression each time they name it."""
    return F.explode(F.array(c))


def clean(c: Column) -> Column:
    """Trimmed, white space collapsed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def present(c: Column) -> Column:
    """Null for null and blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[present(c) for c in columns])


def fold(c: Column) -> Column:
    """Letters without their marks; other non-ASCII characters are dropped. Latin letters only. Plain text, of a byte a letter, stays as it is."""
    plain = (F.octet_length(c) == F.length(c)) & F.is_valid_utf8(c)
    return F.when(plain, c).otherwise(F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[^\x00-\x7F]", ""))


def slug(c: Column) -> Column:
    """Folded, lower case, everything but letters and digits squeezed to one underscore."""
    return F.btrim(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "_"), F.lit("_"))


def slug_keep_case(c: Column) -> Column:
    found = F.btrim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Otros"))


def squeeze(c: Column) -> Column:
    """Only lower-case letters and digits."""
    return F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "")


def upper_label(c: Column) -> Column:
    plain = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"\P{Alnum}+", " ")  # ASCII letters and digits, by one look at a table
    return F.trim(F.upper(plain))  # ASCII only by now


def file_name(c: Column, longest: int = 180) -> Column:
    """Safe as a file name."""
    return F.left(F.btrim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit(longest))


def strip_html(c: Column) -> Column:
    """Tags removed, the common entities replaced, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean(out)


def cascade(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The first pattern's match that isn't empty, in order."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


# Words for missing, squeezed.
ABSENT = ["", "nodisponible", "na", "none", "null", "sindato", "nohaydato"]


def is_present(c: Column) -> Column:
    """Whether a report value says something: not blank and no word for missing."""
    return ~squeeze(c).isin(ABSENT)


def party_name(c: Column) -> Column:
    """The text if it may name someone, else empty: a name has a letter in it, so dates, amounts and numbers are none."""
    text = F.trim(c)
    return F.coalesce(F.when(text.rlike(r"\p{L}"), text), F.lit(""))


def cut_at(c: Column, words: list[str]) -> Column:
    """The text before the first of the words (without regard to case), trimmed."""
    places = [F.nullif(F.instr(F.upper(c), w.upper()), F.lit(0)) for w in words]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.trim(F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1)))


def after_label(line: Column, labels: list[str]) -> Column:
    """What stands after a label on its line, without separators; empty if the line has none of the labels."""
    found = F.lit("")
    for name in reversed(labels):
        found = F.when(line.ilike(f"%{name}%"), F.regexp_extract(line, rf"(?i){name}\s*[:.\-]*\s*(.*)$", 1)).otherwise(found)
    return F.trim(found)
