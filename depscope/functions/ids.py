"""Identifiers of entities and relationships, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(path: Column) -> Column:
    """A path with either kind of slash as a dotted name, without a trailing ``.py``."""
    return F.regexp_replace(F.translate(path, "/\\", ".."), r"\.py$", "")


def package_id(path: Column) -> Column:
    return F.concat(F.lit("pkg:"), F.translate(path, "/\\", ".."))


def module_id(path: Column) -> Column:
    return F.concat(F.lit("mod:"), dotted(path))


def class_id(module: Column, name: Column) -> Column:
    return F.concat(F.lit("cls:"), module, F.lit(":"), name)


def method_id(owner: Column, name: Column, line: Column, module: Column) -> Column:
    """A method's id by its class; a function, with a null class, is named by its module."""
    tail = F.concat(F.lit(":"), name, F.lit(":"), line.cast("string"))
    return F.when(owner.isNotNull(), F.concat(F.lit("meth:"), owner, tail)).otherwise(
        F.concat(F.lit("func:"), module, tail)
    )


def field_id(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("field:"), owner, F.lit(":"), name)


def relationship_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel:"), source, F.lit("->"), target, F.lit(":"), kind)
