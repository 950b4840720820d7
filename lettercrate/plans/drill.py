"""The drill-down: group by a field, choose a group, group what is left by the next field."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lettercrate.functions.filters import Predicate, chosen
from lettercrate.operators import query
from lettercrate.plans.fields import DEFAULT, GROUPABLE, FieldMap


@dataclass(frozen=True)
class DrillDown:
    """A place in a drill-down. Methods give new objects or lazy DataFrames; nothing is computed here.

    levels: the fields grouped by so far, the last one now; picks: the values chosen for all but the last.
    """

    df: DataFrame
    levels: tuple[str, ...] = query.LEVELS[:1]
    picks: tuple[tuple[str, object], ...] = ()
    filters: tuple[Predicate, ...] = ()
    fields: FieldMap = DEFAULT
    defaults: tuple[str, ...] = query.LEVELS
    groupable: tuple[str, ...] = GROUPABLE

    @property
    def predicates(self) -> list[Predicate]:
        return [*(chosen(n, v) for n, v in self.picks), *self.filters]

    def segments(self) -> DataFrame:
        return query.segments(self.df, self.levels[-1], self.predicates, self.fields)

    def push(self, value: object) -> DrillDown:
        """Chooses a group of the current level and goes to the next default level."""
        if not self.can_aggregate_more():
            raise IndexError("there is no further level")
        return replace(self, picks=(*self.picks, (self.levels[-1], value)), levels=(*self.levels, self.defaults[len(self.levels)]))

    def pop(self) -> DrillDown:
        """Goes back a level; at the first one it stays."""
        return replace(self, picks=self.picks[:-1], levels=self.levels[:-1]) if self.picks else self

    def set_aggregation(self, index: int, name: str) -> DrillDown:
        """Groups level ``index`` by another field. Groups chosen before keep the field they were chosen by."""
        if name not in self.aggregation_fields(index):
            raise ValueError(f"{name} isn't free for level {index}")
        return replace(self, levels=(*self.levels[:index], name, *self.levels[index + 1 :]))

    def aggregation_fields(self, index: int) -> list[str]:
        """Fields that level ``index`` can be grouped by: its own, and those that no level uses."""
        return [n for n in self.groupable if n == self.levels[index] or n not in self.levels]

    def aggregated_by(self) -> list[tuple[str, object | None, int]]:
        """(field, chosen value or None, index) of each level."""
        values = [v for _, v in self.picks]
        return [(n, values[i] if i < len(values) else None, i) for i, n in enumerate(self.levels)]

    def can_aggregate_more(self) -> bool:
        return len(self.levels) < len(self.defaults)

    def set_filters(self, *filters: Predicate) -> DrillDown:
        return replace(self, filters=filters)

    def items(self, start: int, end: int, names: tuple[str, ...] = ("path", "subject"), include_filters: bool = True, overscan: int = 0) -> DataFrame:
        """A page of the mails in the current selection. include_filters=False: chosen groups only."""
        picked = self.predicates if include_filters else [chosen(n, v) for n, v in self.picks]
        return query.page(self.df, names, start, end, picked, self.fields, overscan=overscan)

    def count(self) -> DataFrame:
        return query.segment_total(self.segments())
