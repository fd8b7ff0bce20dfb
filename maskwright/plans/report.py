"""Counters of a run, never values: as JSON and as text."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.anonymize import COUNTERS, TablePlan, count_states


def thousands(n: int) -> str:
    return f"{n:,}".replace(",", " ")


def plural(n: int, word: str) -> str:
    return word if n == 1 else word + "s"


@dataclass
class TableReport:
    rows_in: int = 0
    rows_out: int = 0
    skipped: bool = False
    columns: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def touched(self) -> int:
        return sum(c["transformed"] + c["truncated"] + c["unchanged"] > 0 or (c["null"] > 0 and c["kept"] == 0) for c in self.columns.values())

    @property
    def truncated(self) -> int:
        return sum(c["truncated"] for c in self.columns.values())


@dataclass
class Report:
    mode: str
    tables: dict[str, TableReport] = field(default_factory=dict)
    raw_notable: list[str] = field(default_factory=list)
    duration_ms: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    def write_json(self, folder: str) -> Path:
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        (out / "last-report.json").write_text(self.to_json())
        return out / "last-report.json"

    def text(self, verbose: bool = False) -> str:
        total = sum(t.rows_out for t in self.tables.values())
        lines = [f"{self.mode}: {thousands(total)} rows, {len(self.tables)} {plural(len(self.tables), 'table')}, {self.duration_ms / 1000:.1f} s"]
        idle = []
        for name, t in sorted(self.tables.items()):
            if t.skipped:
                lines.append(f"  {name}: skipped, structure only")
            elif verbose:
                lines.append(f"  {name}: {thousands(t.rows_out)} rows")
                lines += [f"    {c}: " + ", ".join(f"{thousands(x[s])} {s}" for s in COUNTERS) for c, x in t.columns.items() if x["transformed"] or x["null"] or x["unchanged"]]
            elif not t.touched:
                idle.append(name)
            else:
                lines.append(f"  {name}: {thousands(t.rows_out)} rows, {t.touched} {plural(t.touched, 'column')}" + (f", warning: {thousands(t.truncated)} truncated" if t.truncated else ""))
        if idle:
            lines.append(f"  untouched: {', '.join(idle)}")
        if self.raw_notable:
            lines.append(f"  passed on as they are: {', '.join(self.raw_notable)}")
        return "\n".join(lines)


def report(mode: str, tables: dict[str, tuple[DataFrame, TablePlan]], key: bytes, notable: list[str] | None = None) -> Report:
    """Counts what the plans do to the tables: one aggregate for each table, a row for each column."""
    began = time.time()
    out = Report(mode, raw_notable=notable or [])
    for name, (df, plan) in sorted(tables.items()):
        n = df.agg(F.count("*")).first()[0]
        t = out.tables[name] = TableReport(n, 0 if plan.skipped else n, plan.skipped)
        if not plan.skipped:
            t.columns = {r["column"]: {s: r[s] for s in COUNTERS} for r in count_states(df, plan, key).collect()}
    out.duration_ms = int((time.time() - began) * 1000)
    return out
