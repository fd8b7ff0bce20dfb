"""Does a config decide on every column that looks personal?"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from maskwright.operators.classify import Classification, classify, missing_mandatory, needs_review
from maskwright.plans.config import Config


@dataclass
class CheckResult:
    tables: int
    missing: list[tuple[str, str, Classification]] = field(default_factory=list)
    review: list[tuple[str, str, Classification]] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    unused: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not (self.missing or self.review or self.conflicts or self.pending)

    def text(self) -> str:
        out = [f"warning: pattern {p} of {s} matches no column" for p, s in self.unused]
        if self.ok:
            return "\n".join([*out, f"check OK: {self.tables} tables, every sensitive column has a rule"])
        listed = lambda some: [f"  {t}.{c}: {x.reason}" for t, c, x in some]
        for title, lines in (
            ("Sensitive columns without a rule:", listed(self.missing)),
            ("Columns to look at:", listed(self.review)),
            ("Columns decided in several places:", [f"  {c}" for c in self.conflicts]),
            ("Still under review:", [f"  {p}" for p in self.pending]),
        ):
            out += [title, *lines] if lines else []
        out.append("check FAILED")
        if self.missing or self.review:
            out.append("Give each of these columns a rule, or list it under exclude.")
        if self.conflicts:
            out.append("Leave one decision for each of these columns.")
        if self.pending:
            out.append("Move each entry to columns to confirm its rule, or its key to exclude.")
        return "\n".join(out)


def check(tables: dict[str, DataFrame], config: Config, order: dict[str, list[str]] | None = None, values: DataFrame | None = None) -> CheckResult:
    found = classify(tables, order, values)
    conflicts = [f"{t}.{c}: {' and '.join(s)}" for t, c in found if not config.exempt(t) and len(s := config.decisions_for(t, c)) > 1]
    columns = [(t, c) for t, df in tables.items() for c in df.columns]
    return CheckResult(len(tables), missing_mandatory(found, config), needs_review(found, config), conflicts, list(config.review), config.unused_patterns(columns))
