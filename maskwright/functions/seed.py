"""Keyed seeds (HMAC-SHA256) and draws from them, as SQL text for Spark or for DuckDB.

A value's seed is 64 hex digits of HMAC(key, label, 0x00, value); draws are slices of it. Both engines compute the same, so a rule's
results can be checked outside Spark.
"""

from __future__ import annotations

import hashlib
import hmac


def padded_key(key: bytes) -> bytes:
    return (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")


def seed_text(key: bytes, label: str, value: str) -> str:
    """The seed in plain Python, for tests and the driver."""
    return hmac.new(key, label.encode() + b"\0" + value.encode(), hashlib.sha256).hexdigest()


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Spark:
    """How Spark spells what the presets need."""

    name = "spark"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def seed(self, key: bytes, label: str, value: str) -> str:
        k = padded_key(key)
        inner = "X'" + (bytes(x ^ 0x36 for x in k) + label.encode() + b"\0").hex().upper() + "'"
        outer = "X'" + bytes(x ^ 0x5C for x in k).hex().upper() + "'"
        return f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast({value} as binary)), 256))), 256)"

    def number(self, hex_digits: str) -> str:
        return f"cast(conv({hex_digits}, 16, 10) as bigint)"

    def pick(self, items: list[str], at: str) -> str:
        return f"element_at(array({', '.join(map(self.text, items))}), cast({at} as int) + 1)"

    def sha(self, text: str) -> str:
        return f"sha2(cast({text} as binary), 256)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} rlike {self.text(pattern)})"

    def replaced(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, {self.text(by)})"

    def each(self, count: str, one) -> str:
        """Text made by ``one(i)`` for i from 1 to count."""
        return f"array_join(transform(sequence(1, greatest(1, cast({count} as int))), i -> {one('i')}), '')"

    def folded(self, count: str, start: str, one) -> str:
        """A number: ``one(acc, i)`` for i from 1 to count."""
        return f"aggregate(sequence(1, greatest(1, cast({count} as int))), cast({start} as bigint), (acc, i) -> cast({one('acc', 'i')} as bigint))"

    def let(self, value: str, one, name: str = "x") -> str:
        """``one(name)`` with name standing for value, which is computed once."""
        return f"element_at(transform(array({value}), {name} -> {one(name)}), 1)"

    def letter(self, code: str) -> str:
        return f"char({code})"

    def code(self, s: str) -> str:
        return f"ascii({s})"

    def integer(self, s: str) -> str:
        return f"try_cast({s} as bigint)"

    def day(self, y: str, m: str, d: str) -> str:
        """The date of year, month and day, of which a day beyond the month's end rolls over."""
        return f"date_add(make_date({y}, {m}, 1), cast({d} as int) - 1)"

    def dated(self, text: str, odd: str) -> str:
        """The date of a text: as the engine reads it if it is one in full, else ``odd``, which is slow."""
        plain = f"{text} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' and {text} >= '0001' and {text} < '9999'"
        return f"coalesce(case when {plain} then try_cast({text} as date) end, {odd})"

    def moved(self, date: str, days: str) -> str:
        return f"date_format(date_add({date}, cast({days} as int)), 'yyyy-MM-dd')"


class Duck(Spark):
    """How DuckDB does."""

    name = "duckdb"

    def text(self, s: str) -> str:
        return quoted(s)

    def seed(self, key: bytes, label: str, value: str) -> str:
        k = padded_key(key)
        inner = (bytes(x ^ 0x36 for x in k) + label.encode() + b"\0").hex()
        outer = bytes(x ^ 0x5C for x in k).hex()
        return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(cast({value} as varchar)))))"

    def number(self, hex_digits: str) -> str:
        return f"cast('0x' || {hex_digits} as bigint)"

    def pick(self, items: list[str], at: str) -> str:
        return f"([{', '.join(map(self.text, items))}])[cast({at} as integer) + 1]"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.text(pattern)})"

    def replaced(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def each(self, count: str, one) -> str:
        return f"array_to_string(list_transform(range(1, greatest(1, cast({count} as bigint)) + 1), lambda i: {one('i')}), '')"

    def folded(self, count: str, start: str, one) -> str:
        return f"list_reduce(range(1, greatest(1, cast({count} as bigint)) + 1), lambda acc, i: cast({one('acc', 'i')} as bigint), cast({start} as bigint))"

    def let(self, value: str, one, name: str = "x") -> str:
        return f"list_transform([{value}], lambda {name}: {one(name)})[1]"

    def letter(self, code: str) -> str:
        return f"chr(cast({code} as integer))"

    def day(self, y: str, m: str, d: str) -> str:
        return f"(make_date({y}, {m}, 1) + cast({d} - 1 as integer))"

    def dated(self, text: str, odd: str) -> str:
        return odd

    def moved(self, date: str, days: str) -> str:
        return f"strftime({date} + cast({days} as integer), '%Y-%m-%d')"


def draw(d: Spark, seed: str, i: int, n: int) -> str:
    """Draw i (0 to 4) from a seed: a number below n, of 48 bits of it."""
    return f"({d.number(f'substr({seed}, {12 * i + 1}, 12)')} % {n})"
