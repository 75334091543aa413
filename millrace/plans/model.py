"""The package: what is measured, how tables hang together, and what may be asked."""

from __future__ import annotations

from dataclasses import dataclass, field

STATISTICS = ("sum", "count", "count_distinct", "avg", "min", "max", "median", "percentile", "first_value", "last_value", "single_value")


@dataclass(frozen=True)
class Entity:
    """A table and its key; no key means row grain (duplicates count). row_filter is SQL that every read applies.
    zero_through says how far the table is loaded: by its last row ("data"), up to the call's now ("now"), or by the largest value of a
    column of a load log, ("loaded", table, column). The package's own holds where none is given."""

    table: str
    key: tuple[str, ...] = ()
    row_filter: str | None = None
    zero_through: str | tuple[str, ...] | None = None


@dataclass(frozen=True)
class Relationship:
    """Many `source` rows to one `target` row, by equal columns; valid_from/valid_to make it a history join at the query's clock.
    forward: no group is read from the target's side; its measures are read from the source's rows instead."""

    source: str
    target: str
    on: tuple[tuple[str, str], ...]
    valid: tuple[str, str] | None = None
    forward: bool = False


@dataclass(frozen=True)
class Dimension:
    """key: a dimension that tells namesakes apart; grouping by a name also groups by its key."""

    entity: str
    expr: str
    unknown: tuple[str, ...] = ()
    key: str | None = None


@dataclass(frozen=True)
class Clock:
    """A column that dates rows; one stored in a time zone (`stored`) is read in another (`zone`)."""

    entity: str
    column: str
    stored: str | None = None
    zone: str | None = None


@dataclass(frozen=True)
class Measure:
    """expr is a SQL expression on the entity's table. stock=(clock, series columns): one snapshot of each series a period counts.
    lookup=(parent, measure): in place of expr, the all-time total of another measure for the row's parent; such a value can't be summed."""

    entity: str
    expr: str
    agg: str = "sum"
    allowed: tuple[str, ...] = STATISTICS
    clock: str | None = None
    additive: bool = True
    stock: tuple[str, ...] | None = None
    lookup: tuple[str, str] | None = None


@dataclass(frozen=True)
class Rollup:
    """A table of sums and counts: columns of measures and dimensions, and the start of each period of `grain` by a clock."""

    table: str
    measures: dict[str, str]
    dimensions: dict[str, str] = field(default_factory=dict)
    clock: str | None = None
    period: str | None = None
    grain: str | None = None


@dataclass(frozen=True)
class Package:
    entities: dict[str, Entity]
    relationships: tuple[Relationship, ...] = ()
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    clocks: dict[str, Clock] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)
    preferences: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)
    denied: frozenset[str] = frozenset()
    rollups: tuple[Rollup, ...] = ()
    #: Measures and metrics that may rank groups but aren't shown: name -> how many groups at most.
    withheld: dict[str, int] = field(default_factory=dict)
    max_hops: int = 4
    zero_through: str | tuple[str, ...] = "data"
    #: How a measure or metric may be asked: name -> rules, see governance.py.
    constraints: dict[str, dict] = field(default_factory=dict)

    def edge_of(self, entity: str) -> str | tuple[str, ...]:
        return self.entities[entity].zero_through or self.zero_through
