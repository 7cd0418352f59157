"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Estimated tokens: four characters each, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def three_places(x: Column) -> Column:
    """A number with three decimals, halves to the even side; by whole thousandths, so that every engine agrees."""
    n = F.abs(F.rint(x * 1000)).cast("long")
    return F.concat(F.when(F.rint(x * 1000) < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def node_id(kind: Column, ident: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit("-"), ident.cast("string"))


def keyed(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '|': an order or a draw that depends on them alone."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw(key: Column, n: Column) -> Column:
    """A number from 0 to n-1 from the first 32 bits of an md5."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def word_list(text: Column, longer_than: int = 0) -> Column:
    """Lower-case words separated by ASCII white space."""
    return F.filter(F.split(F.lower(F.trim(text)), "\\s+"), lambda w: F.length(w) > longer_than)
