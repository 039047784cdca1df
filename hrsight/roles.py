"""Column roles.

Every operator addresses columns through a role map instead of hard-coded
names, so the same plan runs on the HR sample files and on any other table.
A role whose column is absent from the frame is simply skipped: the operator
drops the metric (or returns NULL) the way the reference skips a missing
column.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Default column names per role (the sample HR header).
DEFAULT_ROLES: dict[str, str] = {
    "id": "EmployeeID",
    "department": "Department",
    "job_role": "JobRole",
    "gender": "Gender",
    "education": "Education",
    "education_level": "EducationLevel",
    "age": "Age",
    "income": "MonthlyIncome",
    "tenure": "YearsAtCompany",
    "satisfaction": "JobSatisfaction",
    "environment": "EnvironmentSatisfaction",
    "worklife": "WorkLifeBalance",
    "involvement": "JobInvolvement",
    "rating": "PerformanceRating",
    "overtime": "OverTime",
    "promotion_gap": "YearsSinceLastPromotion",
    "training": "TrainingTimesLastYear",
}

# Label column aliases, first match wins (union of the two
# lists the reference uses, in its order).
LABEL_ALIASES: tuple[str, ...] = (
    "Attrition", "attrition", "Attrition_Flag", "Left", "left", "turnover", "Turnover",
)

# Id column fallbacks for scoring output and search.
ID_FALLBACKS: tuple[str, ...] = ("EmployeeID", "EmployeeNumber")
SEARCH_COLUMNS: tuple[str, ...] = ("EmployeeID", "EmployeeNumber", "Name", "FirstName", "LastName")


@dataclass(frozen=True)
class Roles:
    names: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_ROLES))
    label: str | None = None  # explicit label column; else first alias present

    @classmethod
    def of(cls, roles: "Roles | Mapping[str, str] | None" = None, **overrides: str) -> "Roles":
        if isinstance(roles, Roles):
            base = dict(roles.names)
            label = roles.label
        else:
            base = dict(DEFAULT_ROLES)
            base.update(roles or {})
            label = base.pop("label", None)
        label = overrides.pop("label", label)
        base.update(overrides)
        return cls(base, label)

    def col(self, df: DataFrame, role: str) -> str | None:
        """Column name for ``role`` if the frame has it, else None."""
        name = self.names.get(role)
        return name if name is not None and name in df.columns else None

    def has(self, df: DataFrame, *roles: str) -> bool:
        return all(self.col(df, r) is not None for r in roles)

    def label_col(self, df: DataFrame) -> str | None:
        if self.label is not None:
            return self.label if self.label in df.columns else None
        return next((c for c in LABEL_ALIASES if c in df.columns), None)

    def id_col(self, df: DataFrame) -> str | None:
        own = self.col(df, "id")
        if own:
            return own
        return next((c for c in ID_FALLBACKS if c in df.columns), None)
