"""Rule configurations, results, contracts and metric rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Severity(str, Enum):
    CRITICAL = "critical"
    WARNING = "warning"
    INFO = "info"


class Layer(str, Enum):
    BRONZE = "bronze"
    SILVER = "silver"
    GOLD = "gold"


def _need(value: Any, what: str) -> None:
    if not value:
        raise ValueError(f"{what} must not be empty")


@dataclass(frozen=True)
class Rule:
    """What all rules share. Severity and layer may be given as text in any case."""

    rule_id: str
    rule_version: str = "1.0"
    severity: Severity = Severity.WARNING
    layer: Layer = Layer.BRONZE
    enabled: bool = True
    description: str = ""
    owner: str = ""

    def __post_init__(self) -> None:
        _need(self.rule_id, "rule_id")
        for name, kind in (("severity", Severity), ("layer", Layer)):
            value = getattr(self, name)
            if not isinstance(value, kind):
                object.__setattr__(self, name, kind(str(value).lower()))


@dataclass(frozen=True)
class NotNull(Rule):
    column: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.column, "column")


@dataclass(frozen=True)
class UniqueKey(Rule):
    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.columns, "columns")
        object.__setattr__(self, "columns", tuple(self.columns))


@dataclass(frozen=True)
class AcceptedValues(Rule):
    """Values from a list, or from a column of a reference table given at run time."""

    column: str = ""
    values: tuple[str, ...] = ()
    case_sensitive: bool = False
    reference_table: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.column, "column")
        object.__setattr__(self, "values", tuple(self.values))
        if not self.values and not self.reference_table:
            raise ValueError("values or reference_table must be given")


@dataclass(frozen=True)
class PositiveNumeric(Rule):
    column: str = ""
    allow_zero: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.column, "column")


@dataclass(frozen=True)
class Freshness(Rule):
    column: str = ""
    max_age_hours: float = 24.0

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.column, "column")
        if self.max_age_hours <= 0:
            raise ValueError("max_age_hours must be positive")


@dataclass(frozen=True)
class Duplicates(Rule):
    key_columns: tuple[str, ...] = ()
    order_by: str | None = None
    keep: str = "last"

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.key_columns, "key_columns")
        object.__setattr__(self, "key_columns", tuple(self.key_columns))
        if self.keep not in ("first", "last"):
            raise ValueError("keep must be first or last")


@dataclass(frozen=True)
class SchemaDrift(Rule):
    expected_columns: tuple[str, ...] = ()
    allow_extra: bool = False
    alert_on_missing: bool = True
    alert_on_type_change: bool = True
    expected_schema: StructType | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.expected_columns and self.expected_schema is not None:
            object.__setattr__(self, "expected_columns", tuple(self.expected_schema.fieldNames()))
        _need(self.expected_columns, "expected_columns")
        object.__setattr__(self, "expected_columns", tuple(self.expected_columns))


@dataclass(frozen=True)
class ReferentialIntegrity(Rule):
    child_column: str = ""
    parent_table: str = ""
    parent_column: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.child_column, "child_column")
        _need(self.parent_column, "parent_column")


@dataclass(frozen=True)
class RowCountAnomaly(Rule):
    min_deviation_pct: float = -30.0
    max_deviation_pct: float = 50.0
    lookback: int = 10

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_deviation_pct > 0 or self.max_deviation_pct < 0 or self.lookback < 1:
            raise ValueError("bounds must enclose 0 and lookback be at least 1")


@dataclass(frozen=True)
class DistributionAnomaly(Rule):
    column: str = ""
    z_threshold: float = 3.0
    bands: tuple[float, ...] = (0.25, 0.5, 0.75)
    max_drift_pct: float = 20.0
    min_sample: int = 100
    approximate: bool = True
    relative_error: float = 0.01

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.column, "column")
        object.__setattr__(self, "bands", tuple(self.bands))


@dataclass
class CheckResult:
    """The uniform result of a rule. ``failed_df`` is lazy, or None where no row can be blamed."""

    rule_id: str
    passed: bool
    total_records: int = 0
    failed_records: int = 0
    rule_version: str = "1.0"
    severity: str = "warning"
    layer: str = ""
    dataset: str = ""
    skipped: bool = False
    metadata: dict[str, Any] = field(default_factory=dict)
    failed_df: DataFrame | None = None
    elapsed_ms: float = 0.0

    @property
    def failure_rate(self) -> float:
        """Share of failed records, 0 to 1."""
        return self.failed_records / self.total_records if self.total_records else 0.0

    @property
    def pass_rate(self) -> float:
        """Percentage of passed records, 0 to 100."""
        return 100.0 * (1 - self.failure_rate)

    def summary(self) -> str:
        state = "SKIPPED" if self.skipped else "PASSED" if self.passed else "FAILED"
        return f"[{state}] {self.rule_id} on {self.dataset or '-'}: {self.failed_records} of {self.total_records} failed ({self.severity})"

    def to_metrics(self) -> dict[str, Any]:
        return {
            "rule_name": self.rule_id,
            "rule_version": self.rule_version,
            "passed": self.passed,
            "severity": self.severity,
            "layer": self.layer,
            "dataset_name": self.dataset,
            "total_records": self.total_records,
            "failed_records": self.failed_records,
            "failure_rate": self.failure_rate,
            "pass_rate": self.pass_rate,
            "execution_time_ms": self.elapsed_ms,
        }


@dataclass(frozen=True)
class Contract:
    """What a dataset promises: schema, key, quality bounds, freshness."""

    dataset: str
    layer: str
    schema: StructType
    primary_key: tuple[str, ...]
    allow_evolution: bool = False
    min_not_null: dict[str, float] = field(default_factory=dict)
    max_duplicate_rate: float = 0.0
    max_freshness_hours: float = 24.0
    freshness_column: str | None = None
    min_rows: int = 0
    max_rows: int | None = None
    version: str = "1.0"
