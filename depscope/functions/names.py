"""Dotted names: depth, packages, labels, closeness."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(name: Column) -> Column:
    return F.split(name, r"\.")


def depth(name: Column) -> Column:
    """Count of dots."""
    return F.size(parts(name)) - 1


def label(name: Column) -> Column:
    """A name of more than 20 characters is broken behind its dots."""
    return F.when(F.length(name) > 20, F.replace(name, F.lit("."), F.lit(".\n"))).otherwise(name)


def package_of(name: Column) -> Column:
    """The first part of a name that has more; null for a top-level name."""
    return F.when(depth(name) > 0, F.split_part(name, F.lit("."), F.lit(1)))


def package_path(path: Column, package: Column) -> Column:
    """The path up to the directory named as the package; null if there is none."""
    steps = F.split(path, "/")
    at = F.array_position(steps, package).cast("int")
    return F.when(at > 0, F.array_join(F.slice(steps, F.lit(1), at), "/"))


def truncated(name: Column, most: int) -> Column:
    """The first ``most`` parts; 0 or less leaves the name whole."""
    return name if most <= 0 else F.array_join(F.slice(parts(name), 1, most), ".")


def without_leading_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"^\.+", "")


def is_legal(name: Column) -> Column:
    """Whether each part is an identifier and no reserved word."""
    words = F.array(*map(F.lit, sorted(keyword.kwlist)))
    grammar = name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")
    return grammar & ~F.arrays_overlap(parts(name), words)


def common_prefix(a: Column, b: Column) -> Column:
    """How many parts from the start are equal."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("long")


def proximity(a: Column, b: Column) -> Column:
    """Equal parts among the first four places, 1 at least."""
    both = F.zip_with(F.slice(parts(a), 1, 4), F.slice(parts(b), 1, 4), lambda x, y: x == y)
    return F.greatest(F.lit(1), F.size(F.filter(both, lambda e: F.coalesce(e, F.lit(False)))))


def dissimilarity(a: Column, b: Column) -> Column:
    """Four less the equal places among the first four; two missing parts are equal."""
    pa, pb = parts(a), parts(b)
    return F.lit(4) - sum(F.get(pa, F.lit(k)).eqNullSafe(F.get(pb, F.lit(k))).cast("int") for k in range(4))


def edge_strength(source: Column, target: Column, efferent: Column, afferent: Column) -> Column:
    """Strength of an import, 5 at most, by the source's imports, the target's importers,
    the names' common start and their depths."""
    gap = F.abs(depth(source) - depth(target))
    value = (
        F.when(efferent > 0, 1.0 + 1.0 / efferent).otherwise(1.0)
        * F.when(afferent > 0, 1.0 + afferent * 0.1).otherwise(1.0)
        * (1.0 + common_prefix(source, target) * 0.5)
        * F.when(gap == 0, 1.2).when(gap == 1, 1.1).otherwise(1.0)
    )
    return F.least(F.lit(5.0), value)
