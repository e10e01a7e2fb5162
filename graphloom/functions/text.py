"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = " [SEP] "


def cluster_or_unknown(kind: Column) -> Column:
    """Cluster of a type as records name it: two parts of what begins with /base/, else the part after the first slash, else "unknown"."""
    p = F.split(kind, "/")
    return F.when(F.startswith(kind, F.lit("/base/")), F.concat(F.lit("/base/"), p[2])).otherwise(F.coalesce(F.get(p, F.lit(1)), F.lit("unknown")))


def cluster(kind: Column) -> Column:
    """Cluster of a type as the dictionary names it: "base" may follow any first part; flat types are their own."""
    p = F.split(kind, "/")
    return F.when(F.size(p) < 2, kind).when(p[1] == "base", F.concat(F.lit("/base/"), F.coalesce(F.get(p, F.lit(2)), F.lit("")))).otherwise(p[1])


def description(label: Column, text: Column, mode: str = "hybrid") -> Column:
    """``label, description``, the description, or the label; an empty description falls back to the label."""
    filled = F.coalesce(text, F.lit("")) != ""
    if mode == "hybrid":
        return F.when(filled, F.concat(label, F.lit(", "), text)).otherwise(label)
    return F.when(filled, text).otherwise(label) if mode == "desc" else label


def relation_text(name: Column) -> Column:
    """Slashes become spaces."""
    return F.trim(F.replace(name, F.lit("/"), F.lit(" ")))


def related_text(text: Column) -> Column:
    """A dot between composed relations is spelt out."""
    return F.replace(text, F.lit("."), F.lit(" is related to "))


def inverse(name: Column) -> Column:
    """Add the inverse mark."""
    return F.concat(F.lit("inv-"), name)


def is_inverse(name: Column) -> Column:
    return F.startswith(name, F.lit("inv-"))


def strip_inverse(name: Column) -> Column:
    return F.when(is_inverse(name), F.substring(name, 5, 1 << 30)).otherwise(name)


def masked_fact(relation: Column, other: Column, direction: Column, cls: str = "[CLS]", mask: str = "[MASK]", sep: str = "[SEP]") -> Column:
    """The entity is masked at its place in the fact."""
    out = F.concat(F.lit(f"{cls} {mask} {sep} "), relation, F.lit(f" {sep} "), other, F.lit(f" {sep}"))
    back = F.concat(F.lit(f"{cls} "), other, F.lit(f" {sep} "), relation, F.lit(f" {sep} {mask} {sep}"))
    return F.when(direction == "inv", back).otherwise(out)


def masked_type(text: Column, cls: str = "[CLS]", mask: str = "[MASK]", sep: str = "[SEP]") -> Column:
    """The entity is masked before its type."""
    return F.concat(F.lit(f"{cls} {mask} has type {sep} "), text, F.lit(f" {sep}"))
