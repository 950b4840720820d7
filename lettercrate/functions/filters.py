"""Predicates on fields. Each is a function of a FieldMap that gives a boolean Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettercrate.plans.fields import DEFAULT, FieldMap

Predicate = Callable[[FieldMap], Column]

_KINDS = {"text": (str,), "int": (int,), "bool": (bool,), "tags": (str,)}


def literal(name: str, value: object, fields: FieldMap = DEFAULT) -> Column:
    """The value as a literal, checked against the field's kind. Null, lists and mappings are refused."""
    if not isinstance(value, (str, bool, int, float)):
        raise TypeError(f"{name}: a {type(value).__name__} can't be compared")
    kind = fields.kind(name)
    fits = _KINDS.get(kind, (str, bool, int, float))
    if not isinstance(value, fits) or (kind == "int" and isinstance(value, bool)):
        raise TypeError(f"{name} is {kind}; got {value!r}")
    return F.lit(value)


def as_text(name: str, fields: FieldMap) -> Column:
    return fields.column(name).cast("string")


def like(name: str, pattern: object) -> Predicate:
    """Case-insensitive match with % and _ as wildcards and no escape character; other types match as text."""
    doubled = str(pattern).replace("\\", "\\\\")
    return lambda fields: as_text(name, fields).ilike(doubled)


def not_like(name: str, pattern: object) -> Predicate:
    """Not like; a null field fails either way."""
    matched = like(name, pattern)
    return lambda fields: ~matched(fields)


def contains(name: str, part: object, wildcards: bool = False) -> Predicate:
    """The field as text has the part in it, in any case. wildcards: % and _ in the part are live."""
    if wildcards:
        return like(name, f"%{part}%")
    return lambda fields: F.contains(F.lower(as_text(name, fields)), F.lower(F.lit(str(part))))


def equals(name: str, value: object) -> Predicate:
    return lambda fields: fields.column(name) == literal(name, value, fields)


def chosen(name: str, value: object) -> Predicate:
    """The drill-down predicate: equality, which reaches the scan. None chooses the group of null, which for texts, and
    fields of unknown kind, is the group of '' too."""
    if value == "" or value is None:

        def missing(fields: FieldMap) -> Column:
            column = fields.column(name)
            textual = fields.kind(name) in ("text", None)
            return column.isNull() | (column == "") if textual else column.isNull()

        return missing
    return equals(name, value)


def has_tag(*tags: str) -> Predicate:
    """The mail has one of the tags at least."""
    if len(tags) == 1:
        return lambda fields: F.array_contains(fields.column("tags"), tags[0])
    return lambda fields: F.arrays_overlap(fields.column("tags"), F.array(*map(F.lit, tags)))


def all_of(predicates: Iterable[Predicate], fields: FieldMap = DEFAULT) -> Column:
    """All of the predicates; none are always true."""
    return reduce(lambda a, b: a & b, (p(fields) for p in predicates), F.lit(True))


def where(df: DataFrame, predicates: Iterable[Predicate], fields: FieldMap = DEFAULT) -> DataFrame:
    return reduce(lambda d, p: d.where(p(fields)), predicates, df)


@dataclass(frozen=True)
class FilterState:
    """The filter form: three-valued switches (None: either), a tag, a part of the subject.

    A new form shows received mails only; it takes effect once its predicates are applied.
    """

    is_send: bool | None = False
    is_seen: bool | None = None
    is_reply: bool | None = None
    tag: str | None = None
    subject: str = ""

    def predicates(self) -> list[Predicate]:
        out = [equals(n, v) for n in ("is_send", "is_seen", "is_reply") if (v := getattr(self, n)) is not None]
        if self.tag:
            out.append(has_tag(self.tag))
        if self.subject:
            out.append(contains("subject", self.subject))
        return out
