"""The rule config: grammar, validation, patterns and precedence. Driver-side, on small data."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

from maskwright.functions.presets import PRESETS

KEY_VARIABLE = "MASKWRIGHT_KEY"
FORBIDDEN = ("dsn", "password", "key")


class ConfigError(ValueError):
    """The config can't be used as it is."""


@dataclass(frozen=True)
class Rule:
    """keep, null, constant (``value``) or preset (``value`` is its name, ``params`` what it takes)."""

    kind: str
    value: str = ""
    params: tuple[tuple[str, str], ...] = ()


KEEP, NULL = Rule("keep"), Rule("null")


def parse_rule(raw: object) -> Rule:
    if raw is None or (isinstance(raw, str) and raw.strip() in ("", "null", "~", "Null", "NULL")):
        return NULL
    if isinstance(raw, str):
        text = raw.strip()
        if text == "keep":
            return KEEP
        if text.startswith("constant"):
            if not (m := re.fullmatch(r'constant\(\s*"(.*)"\s*\)', text, re.S)):
                raise ConfigError(f'a constant is written constant("..."), with quotes: {text}')
            return Rule("constant", m[1])
        if not re.fullmatch(r"[\w-]+", text):
            raise ConfigError(f"not a rule: {text}")
        return Rule("preset", text)
    if isinstance(raw, dict) and isinstance(raw.get("preset"), str):
        return Rule("preset", raw["preset"], tuple((str(k), str(v)) for k, v in raw.items() if k != "preset"))
    raise ConfigError(f"not a rule: {raw!r}")


def glob_match(pattern: str, name: str) -> bool:
    """``*`` stands for any run of characters, also none; all else for itself."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.S) is not None


def pattern_matches(pattern: str, table: str, column: str) -> bool:
    """Both halves of ``table.column``, cut at the first dot; without a dot nothing matches."""
    first, dot, second = pattern.partition(".")
    return bool(dot) and glob_match(first, table) and glob_match(second, column)


def like(pattern: str) -> str:
    """The glob as an SQL LIKE pattern with backslash as escape."""
    return re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%")


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def suggestion(name: str) -> str | None:
    """The known preset nearest to a name, if two edits or fewer away; the first of equals."""
    best = min(PRESETS, key=lambda p: levenshtein(name, p))
    return best if levenshtein(name, best) <= 2 else None


@dataclass
class Config:
    version: int = 1
    kind: str = "mysql"
    mode: str = "anonymize"
    locale: str = "fr_FR"
    on_unclassified: str = "fail"
    tables: dict[str, dict[str, Rule]] = field(default_factory=dict)
    columns: dict[str, Rule] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    review: dict[str, Rule | None] = field(default_factory=dict)  # None: to decide, without a rule
    skip_tables: list[str] = field(default_factory=list)
    truncate_tables: list[str] = field(default_factory=list)
    sampling: dict = field(default_factory=dict)

    def exempt(self, table: str) -> bool:
        return table in self.skip_tables or table in self.truncate_tables

    def rule_for(self, table: str, column: str) -> Rule | None:
        """By exact table entry, else the first pattern of columns, else the first review entry, else exclude, else none."""
        if (found := self.tables.get(table, {}).get(column)) is not None:
            return found
        for section in (self.columns, self.review):
            for pattern, rule in section.items():
                if pattern_matches(pattern, table, column):
                    return rule
        return KEEP if any(pattern_matches(p, table, column) for p in self.exclude) else None

    def decisions_for(self, table: str, column: str) -> list[str]:
        """The sections that decide on a column; tables and columns count as one."""
        hit = lambda patterns: any(pattern_matches(p, table, column) for p in patterns)
        out = []
        if column in self.tables.get(table, {}):
            out.append("tables")
        elif hit(self.columns):
            out.append("columns")
        return out + [s for s in ("review", "exclude") if hit(getattr(self, s))]

    def patterns(self) -> list[tuple[str, str]]:
        return [(p, s) for s in ("columns", "review", "exclude") for p in getattr(self, s)]

    def unused_patterns(self, columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return [(p, s) for p, s in self.patterns() if not any(pattern_matches(p, t, c) for t, c in columns)]

    def validate(self, env: dict[str, str] | None = None) -> Config:
        if self.kind != "mysql":
            raise ConfigError(f"source.kind {self.kind} is not supported, only mysql is")
        if self.locale != "fr_FR":
            raise ConfigError(f"defaults.locale {self.locale} is not supported, only fr_FR is")
        if self.mode not in ("anonymize", "pseudonymize") or self.on_unclassified not in ("fail", "keep"):
            raise ConfigError("mode is anonymize or pseudonymize, on_unclassified fail or keep")
        for pattern, section in self.patterns():
            if "." not in pattern:
                raise ConfigError(f"{section}: {pattern} must be of the form table.column, * allowed")
        named = [(f"{t}.{c}", r) for t, cols in self.tables.items() for c, r in cols.items()] + [*self.columns.items(), *self.review.items()]
        for key, rule in named:
            if rule and rule.kind == "preset" and rule.value not in PRESETS:
                near = suggestion(rule.value)
                raise ConfigError(f"{key}: there is no preset {rule.value}; " + (f"did you mean {near}?" if near else f"known: {', '.join(PRESETS)}"))
        seen: dict[str, str] = {}
        for key, section in [(f"{t}.{c}", "tables") for t, cols in self.tables.items() for c in cols] + self.patterns():
            if seen.setdefault(key, section) != section:
                raise ConfigError(f"{key} is in both {seen[key]} and {section}: decide on a column in one place")
        if self.mode == "pseudonymize" and len((os.environ if env is None else env).get(KEY_VARIABLE, "")) < 16:
            raise ConfigError(f"mode pseudonymize needs {KEY_VARIABLE} of 16 characters or more in the environment")
        return self


def parse(text: str, env: dict[str, str] | None = None) -> Config:
    """Reads and validates. All scalars are text (YAML 1.1 would take a column named ``no`` for a truth value); unknown keys are
    ignored."""
    raw = yaml.load(text, Loader=yaml.BaseLoader) or {}
    if not isinstance(raw, dict):
        raise ConfigError("a config is a map")
    section = lambda name, kind=dict: raw.get(name) or kind()
    for where, keys in (("", raw), ("source.", section("source"))):
        for key in FORBIDDEN:
            if key in keys:
                raise ConfigError(f"{where}{key} must not be in a config: secrets come from the environment")
    review = raw.get("review") or {}
    defaults = section("defaults")
    return Config(
        version=int(raw.get("version") or 1),
        kind=section("source").get("kind", "mysql"),
        mode=raw.get("mode") or "anonymize",
        locale=defaults.get("locale", "fr_FR"),
        on_unclassified=defaults.get("on_unclassified", "fail"),
        tables={t: {c: parse_rule(r) for c, r in (cols or {}).items()} for t, cols in section("tables").items()},
        columns={p: parse_rule(r) for p, r in section("columns").items()},
        exclude=list(section("exclude", list)),
        review={p: None for p in review} if isinstance(review, list) else {p: parse_rule(r) for p, r in review.items()},
        skip_tables=list(section("skip_tables", list)),
        truncate_tables=list(section("truncate_tables", list)),
        sampling=section("sampling"),
    ).validate(env)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def resolve_key(config: Config) -> bytes:
    """Of a run that anonymizes, 32 random bytes that nothing keeps; else the one in the environment."""
    return os.urandom(32) if config.mode == "anonymize" else os.environ[KEY_VARIABLE].encode()
