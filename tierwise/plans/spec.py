"""Column roles, re-allocation policies and recency rules.

Everything an operator needs to know about the caller's table is carried by
three small immutable values:

* :class:`ColumnSpec` names the columns that play each role (entity, category,
  observation time, source table, code-present flag).
* :class:`TierPolicy` says which category codes are "not valid" (bottom tier)
  and which are "other" (middle tier); every other code, NULL included, is
  "valid" (top tier).
* :class:`Rule` says how a same-day conflict in recency is settled: not at all,
  by a source-table priority, or by a code-present flag.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.keys import orderable

# Helper columns added inside operators all start with this prefix, so they can
# never collide with (or silently replace) a caller's column.
RESERVED_PREFIX = "__tw_"

# The value written where a result cannot be settled (tie or conflict).
UNRESOLVED = "unresolved"


class Rule(str, Enum):
    """How conflicts between records on the latest date are settled."""

    NONE = "none"      # no tie-breaker (talking-therapies style data)
    SOURCE = "source"  # prefer records by source-table priority (hospital style data)
    FLAG = "flag"      # prefer records whose code-present flag is highest (GP style data)

    @classmethod
    def for_dataset(cls, dataset: str) -> "Rule":
        """Map a data-source name to its rule; unknown names are an error."""
        try:
            return DATASET_RULES[dataset.upper()]
        except KeyError:
            raise ValueError(
                f"unknown dataset {dataset!r}; expected one of {sorted(DATASET_RULES)}"
            ) from None


# Data-source names and the rule each one uses.
DATASET_RULES = {"IAPT": Rule.NONE, "HES": Rule.SOURCE, "GP": Rule.FLAG}

# Source-table priority for Rule.SOURCE, best first.
DEFAULT_SOURCE_ORDER = ("apc", "ae", "op")


@dataclass(frozen=True)
class ColumnSpec:
    """Which input column plays which role.

    ``observed_at`` may be of any type that Spark orders: a date, a timestamp, a
    number (for example a year), a text that sorts by time, an interval, a struct.
    """

    entity: str = "entity"
    category: str = "category"
    observed_at: str = "observed_at"
    source: str = "source"
    flag: str = "flag"
    source_order: tuple[str, ...] = DEFAULT_SOURCE_ORDER
    # "Same day" is equality of the raw column by default; a grain compares
    # truncated values instead ("day", "month" or "year"; date-like columns only).
    date_grain: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "source_order", tuple(self.source_order))
        if self.date_grain not in (None, "day", "month", "year"):
            raise ValueError(f"date_grain must be None, 'day', 'month' or 'year', not {self.date_grain!r}")

    def required(self, rule: Rule | None = None, *, dated: bool = False) -> list[str]:
        cols = [self.entity, self.category]
        if dated or rule is not None:
            cols.append(self.observed_at)
        if rule is Rule.SOURCE:
            cols.append(self.source)
        if rule is Rule.FLAG:
            cols.append(self.flag)
        return cols

    def resolved(self, df: DataFrame, rule: Rule | None = None) -> ColumnSpec:
        """This spec with the input's own spelling of each name: as Spark does by
        default, case does not matter (unless ``spark.sql.caseSensitive``)."""
        out = self
        if df.sparkSession.conf.get("spark.sql.caseSensitive", "false") != "true":
            by_lower = {c.lower(): c for c in reversed(df.columns)}
            roles = ("entity", "category", "observed_at", "source", "flag")
            out = replace(self, **{r: by_lower.get(getattr(self, r).lower(), getattr(self, r)) for r in roles if getattr(self, r) not in df.columns})
        out.validate(df, rule)
        return out

    def validate(self, df: DataFrame, rule: Rule | None = None, *, dated: bool = False) -> None:
        """Check the input's schema (no data is read)."""
        names = df.columns
        missing = [c for c in self.required(rule, dated=dated) if c not in names]
        if missing:
            raise ValueError(f"input lacks column(s) {missing}; has {names}")
        clash = [c for c in names if c.startswith(RESERVED_PREFIX)]
        if clash:
            raise ValueError(f"input columns {clash} use the reserved prefix {RESERVED_PREFIX!r}")
        types = dict(df.dtypes)
        if types[self.category] != "string":
            raise TypeError(f"category column {self.category!r} must be string, is {types[self.category]}")
        if dated or rule is not None:
            dt = df.schema[self.observed_at].dataType
            if not orderable(dt):
                raise TypeError(f"observed_at column {self.observed_at!r} is {dt.simpleString()}, which has no order")
            if self.date_grain and not isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise TypeError(f"date_grain needs a date or timestamp column, {self.observed_at!r} is {dt.simpleString()}")
        if rule is Rule.SOURCE and types[self.source] != "string":
            raise TypeError(f"source column {self.source!r} must be string")
        if rule is Rule.FLAG and not isinstance(
            df.schema[self.flag].dataType, (T.IntegralType, T.BooleanType)
        ):
            raise TypeError(f"flag column {self.flag!r} must be integer or boolean")


@dataclass(frozen=True)
class TierPolicy:
    """A re-allocation policy.

    ``not_valid`` codes form tier 0. If ``other`` is non-empty its codes form
    tier 1 and everything else tier 2; otherwise everything else is tier 1.
    A code in both lists is not valid. ``reallocate=False`` selects the
    operators' no-re-allocation forms (every record counts, no tiers).
    """

    name: str
    not_valid: tuple[str, ...] = ()
    other: tuple[str, ...] = ()
    reallocate: bool = True

    def __post_init__(self):
        object.__setattr__(self, "not_valid", tuple(self.not_valid))
        object.__setattr__(self, "other", tuple(self.other))

    @property
    def reallocation_label(self) -> str:
        return "Reallocation" if self.reallocate else "No_reallocation"


# The six published re-allocation presets
# (unknown = 99, X, -1, -3; not stated = Z; any other = S; all others = S, G, L, P, C).
PRESETS: dict[str, TierPolicy] = {
    "none": TierPolicy("Not_reallocated", (), (), reallocate=False),
    "unknown_only": TierPolicy("Unknown_only", ("99", "X", "-1", "-3"), ()),
    "unknown_any_other": TierPolicy(
        "Unknown_and_any_other_reallocated", ("99", "X", "-1", "-3"), ("S",)
    ),
    "unknown_not_stated": TierPolicy("Unknown_not_stated_only", ("99", "X", "-1", "-3", "Z"), ()),
    "unknown_not_stated_any_other": TierPolicy(
        "Unknown_not_stated_and_any_other_reallocated", ("99", "X", "-1", "-3", "Z"), ("S",)
    ),
    "all": TierPolicy("All_reallocation", ("99", "X", "-1", "-3", "Z"), ("S", "G", "L", "P", "C")),
}

DEFAULT_PRESET = "unknown_not_stated_any_other"


def preset(name: str) -> TierPolicy:
    try:
        return PRESETS[name]
    except KeyError:
        raise ValueError(f"unknown preset {name!r}; expected one of {sorted(PRESETS)}") from None


@dataclass(frozen=True)
class RunConfig:
    """Everything that identifies one run: data source, policy, columns."""

    dataset: str
    policy: TierPolicy = field(default_factory=lambda: PRESETS[DEFAULT_PRESET])
    spec: ColumnSpec = field(default_factory=ColumnSpec)

    @property
    def rule(self) -> Rule:
        return Rule.for_dataset(self.dataset)
