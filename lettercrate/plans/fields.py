"""The field catalog, the schemas of the tables, and the mapping of fields to columns of any DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A queryable field. kind: text, int, bool or tags; groupable: may be a drill-down level."""

    name: str
    title: str
    kind: str
    groupable: bool = False


# Names, titles and groupability of the fields.
FIELDS = (
    Field("path", "path", "text"),
    Field("sender_domain", "Domain", "text", True),
    Field("sender_local_part", "Address", "text", True),
    Field("sender_name", "Name", "text", True),
    Field("year", "Year", "int", True),
    Field("month", "Month", "int", True),
    Field("day", "Day", "int", True),
    Field("timestamp", "timestamp", "int"),
    Field("to_group", "Group", "text", True),
    Field("to_name", "To name", "text", True),
    Field("to_address", "To address", "text", True),
    Field("to_count", "to_count", "int"),
    Field("is_reply", "is_reply", "bool"),
    Field("is_send", "is_send", "bool"),
    Field("subject", "Subject", "text"),
    Field("is_seen", "meta_is_seen", "bool"),
    Field("tags", "meta_tags", "tags"),
)
CATALOG = {f.name: f for f in FIELDS}
GROUPABLE = tuple(f.name for f in FIELDS if f.groupable)

TAG_SEPARATOR = ":|:"

EMAILS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("sender_domain", T.StringType()),
    T.StructField("sender_local_part", T.StringType()),
    T.StructField("sender_name", T.StringType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("datetime_utc", T.TimestampType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("to_count", T.LongType()),
    T.StructField("to_group", T.StringType()),
    T.StructField("to_name", T.StringType()),
    T.StructField("to_address", T.StringType()),
    T.StructField("is_reply", T.BooleanType()),
    T.StructField("is_send", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_seen", T.BooleanType()),
    T.StructField("format", T.StringType()),
    T.StructField("position", T.LongType()),
])
RAW = "path string, content binary, path_tags array<string>, seen_hint boolean, format string"
ERRORS = "path string, stage string, message string"
#: Files that were imported: key tells files apart (a Maildir message keeps its key when its flags change), length is how
#: far the file was read.
FILES = "key string, path string, length bigint, modified timestamp"


@dataclass(frozen=True)
class FieldMap:
    """Which column of a table a field is, by name or as a function that makes the expression; fields that aren't listed
    are columns of their own name."""

    columns: dict[str, str | Callable[[], Column]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        found = self.columns.get(name, name)
        return F.col(found) if isinstance(found, str) else found()

    def kind(self, name: str) -> str | None:
        """The field's kind, or None if it is in neither catalog."""
        return self.kinds.get(name) or (CATALOG[name].kind if name in CATALOG else None)

    def select(self, df: DataFrame, *names: str) -> DataFrame:
        return df.select(*[self.column(n).alias(n) for n in names])


DEFAULT = FieldMap()


def title(name: str) -> str:
    return CATALOG[name].title if name in CATALOG else name


def join_tags(tags: Column) -> Column:
    """The tags as one text."""
    return F.array_join(tags, TAG_SEPARATOR)


def split_tags(joined: Column) -> Column:
    """The tags of a joined text; null and '' have none."""
    parts = F.split(F.coalesce(joined, F.lit("")), r":\|:")
    return F.array_remove(parts, "")
