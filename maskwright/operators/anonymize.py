"""Rules on tables: one projection for each, with counters, a guard for sensitive columns and injective unique columns."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.presets import PRESETS
from maskwright.functions.seed import Spark
from maskwright.operators.classify import classify_name
from maskwright.operators.unique import unique_mapping
from maskwright.plans.config import KEEP, Config, ConfigError, Rule, resolve_key

SPARK = Spark()
COUNTERS = ("transformed", "null", "kept", "truncated", "unchanged")


@dataclass
class ColumnInfo:
    """What a table's definition says of a column and a DataFrame's schema may not."""

    name: str
    nullable: bool = True
    max_len: int | None = None
    unique: bool = False
    generated: bool = False
    sql_type: str = ""


def column_infos(df: DataFrame, known: dict[str, ColumnInfo] | None = None) -> list[ColumnInfo]:
    """From ``known``, else from the metadata of the schema's fields, else nullable and without bounds."""
    out = []
    for f in df.schema.fields:
        m = f.metadata or {}
        out.append((known or {}).get(f.name) or ColumnInfo(f.name, m.get("nullable", True), m.get("max_len"), m.get("unique", False), m.get("generated", False), m.get("sql_type", "")))
    return out


def seed_input(df: DataFrame, name: str) -> str:
    """The text of a value that its seed is of: strings as they are, dates and times as ISO text, all else cast."""
    kind, q = df.schema[name].dataType, f"`{name}`"
    if isinstance(kind, T.DateType):
        return f"date_format({q}, 'yyyy-MM-dd')"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({q}, 'yyyy-MM-dd HH:mm:ss')"
    return f"cast({q} as string)"


def _textual(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def _dated(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def applies(rule: Rule, kind: T.DataType) -> bool:
    """Whether a preset changes a column of this type: text, and dates by date_shift. Numbers and binaries are kept."""
    return _textual(kind) or (rule.value == "date_shift" and _dated(kind))


@dataclass
class TablePlan:
    """The compiled rules of one table."""

    table: str
    rules: dict[str, Rule]
    infos: dict[str, ColumnInfo]
    skipped: bool = False
    warnings: list[str] = field(default_factory=list)


def plan_table(table: str, infos: list[ColumnInfo], config: Config, types: dict[str, T.DataType] | None = None) -> TablePlan:
    """Resolves each column's rule; raises for columns decided twice and for sensitive ones without a rule."""
    skipped = config.exempt(table)
    rules: dict[str, Rule] = {}
    warnings, conflicts, open_ = [], [], []
    for c in infos:
        if not skipped and not c.generated and len(sections := config.decisions_for(table, c.name)) > 1:
            conflicts.append(f"{table}.{c.name} (in {' and '.join(sections)})")
        rule = config.rule_for(table, c.name)
        if rule is None and not skipped and not c.generated and config.on_unclassified == "fail" and classify_name(c.name).mandatory:
            open_.append(f"{table}.{c.name}")
        rules[c.name] = rule or KEEP
        if types and rule and rule.kind == "preset" and not applies(rule, types[c.name]):
            warnings.append(f"{table}.{c.name}: {rule.value} does not change values of type {types[c.name].simpleString()}")
    if conflicts:
        raise ConfigError("columns decided in several places: " + ", ".join(conflicts))
    if open_:
        raise ConfigError("sensitive columns without a rule: " + ", ".join(open_))
    return TablePlan(table, rules, {c.name: c for c in infos}, skipped, warnings)


def _constant(df: DataFrame, name: str, value: str) -> Column:
    kind = df.schema[name].dataType
    return F.lit(value).cast(kind) if _textual(kind) else F.lit(value).try_cast(kind)


def transform(df: DataFrame, plan: TablePlan, key: bytes, counters: str | None = None, unique: bool = True) -> DataFrame:
    """The table with its rules applied; with ``counters``, further columns of that prefix that say what became of each value.

    Two projections: seeds, then values. A value's seed is computed once, however many draws it gives; nulls and empty texts pass.
    No shuffle, but for text columns that are unique and have a preset: their values go through an injective mapping, joined back
    by value.
    """
    if plan.skipped:
        return df.where(F.lit(False))
    tag = f"_{uuid.uuid4().hex[:8]}"
    first, second, sources = [F.col(f"`{c}`") for c in df.columns], [], {}
    for n, c in enumerate(df.columns):
        rule, info = plan.rules.get(c, KEEP), plan.infos.get(c) or ColumnInfo(c)
        col = F.col(f"`{c}`")
        out, state = col, F.lit("kept")
        if rule.kind == "null" and info.nullable:
            out, state = F.lit(None).cast(df.schema[c].dataType), F.lit("null")
        elif rule.kind in ("null", "constant"):
            out = F.when(col.isNotNull(), _constant(df, c, rule.value))
            state = F.when(col.isNull(), "null").otherwise("transformed")
        elif rule.kind == "preset" and not applies(rule, df.schema[c].dataType):
            state = F.when(col.isNull(), "null").otherwise("kept")
        elif rule.kind == "preset":
            if unique and info.unique and _textual(df.schema[c].dataType):
                mapping = unique_mapping(df.select(F.col(f"`{c}`").alias("input")), rule, key, info.max_len)
                sources[c] = mapping.select(F.col("input").alias(f"{tag}{n}in"), F.col("output").alias(f"{tag}{n}made"))
                made = F.col(f"{tag}{n}made")
            else:
                preset, text = PRESETS[rule.value], seed_input(df, c)
                seeds = preset.seeds(SPARK, text, key)
                if "date" in seeds and _dated(df.schema[c].dataType):  # a date already
                    seeds["date"] = f"case when year(`{c}`) between 1 and 9998 then cast(`{c}` as date) end"
                first += [F.expr(sql).alias(f"{tag}{n}{label}") for label, sql in seeds.items()]
                value = F.expr(preset.build(SPARK, text, {label: f"{tag}{n}{label}" for label in seeds}, dict(rule.params)))
                made = value if _textual(df.schema[c].dataType) else value.try_cast(df.schema[c].dataType)
            passes = col.isNull() | (col == "") if _textual(df.schema[c].dataType) else col.isNull()
            whole = F.when(passes, col).otherwise(made)
            out = F.left(whole, F.lit(info.max_len)) if info.max_len and _textual(df.schema[c].dataType) else whole
            same = F.when(col.isNull(), "null").when(passes, "kept").when(made == col, "unchanged").otherwise("transformed")
            state = F.when(~passes & (F.length(made) > info.max_len), "truncated").otherwise(same) if info.max_len and c not in sources else same
        second.append(out.alias(c))
        if counters is not None:
            second.append(state.alias(f"{counters}{c}"))
    base = df.select(*first)
    for c, mapping in sources.items():
        at = mapping.columns[0]
        base = base.join(mapping, base[f"`{c}`"] == mapping[at], "left")
    return base.select(*second)


def count_states(df: DataFrame, plan: TablePlan, key: bytes) -> DataFrame:
    """``table, column, transformed, null, kept, truncated, unchanged`` of a table's columns, in one pass over it.

    truncated values are transformed ones too; unchanged are those a preset could not read.
    """
    if plan.skipped:
        rows = [(plan.table, c, 0, 0, 0, 0, 0) for c in df.columns]
        return df.sparkSession.createDataFrame(rows, "table string, column string, transformed long, null long, kept long, truncated long, unchanged long")
    mark = "_state_"
    states = transform(df, plan, key, mark)
    aggs = [F.count_if(F.col(f"`{mark}{c}`") == s if s != "transformed" else F.col(f"`{mark}{c}`").isin("transformed", "truncated")).alias(f"{s}{n}") for n, c in enumerate(df.columns) for s in COUNTERS]
    one = states.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(plan.table).alias("table"), F.lit(c).alias("column"), *[F.col(f"{s}{n}").alias(s) for s in COUNTERS]) for n, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def anonymize(tables: dict[str, DataFrame], config: Config, key: bytes | None = None, known: dict[str, dict[str, ColumnInfo]] | None = None) -> dict[str, DataFrame]:
    """All tables with the config's rules applied. Refuses before anything runs if any table's columns are not decided on."""
    key = resolve_key(config) if key is None else key
    plans = {t: plan_table(t, column_infos(df, (known or {}).get(t)), config, {f.name: f.dataType for f in df.schema.fields}) for t, df in tables.items()}
    return {t: transform(df, plans[t], key) for t, df in tables.items()}
