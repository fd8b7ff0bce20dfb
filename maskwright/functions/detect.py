"""Predicates on single values, as SQL text: what the content classifier looks for."""

from __future__ import annotations

from maskwright.functions.presets import compact, iban_mod, luhn_sum, vat_key
from maskwright.functions.seed import Spark


def _trimmed(d: Spark, v: str) -> str:
    return d.replaced(v, r"^\s+|\s+$", "")


def is_email(d: Spark, v: str) -> str:
    """One @, something before it, a domain of parts with dots between them (and maybe several), no space within."""
    return d.matches(_trimmed(d, v), r"^[^@\s]+@[^@\s.]([^@\s]*)\.([^@\s]*)[^@\s.]$")


def is_phone(d: Spark, v: str) -> str:
    return d.matches(compact(d, v), r"^(\+[0-9]{8,15}|0[0-9]{9})$")


def is_ipv4(d: Spark, v: str) -> str:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return d.matches(_trimmed(d, v), rf"^{part}(\.{part}){{3}}$")


def is_ipv6(d: Spark, v: str) -> str:
    """Eight groups, or fewer around one ``::``; a dotted tail counts as two groups. Written without look-ahead."""
    group, part = "[0-9A-Fa-f]{1,4}", "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    t = _trimmed(d, v)
    v4 = rf"{part}(\.{part}){{3}}"
    plain = d.matches(t, rf"^({group}:){{6}}({group}:{group}|{v4})$")
    shape = d.matches(t, rf"^(({group}:)*{group})?::((({group}:)*({group}|{v4})))?$")
    groups = f"length({d.replaced(d.replaced(t, v4, '0:0'), '[0-9A-Fa-f]+', 'g')}) - length(replace({d.replaced(d.replaced(t, v4, '0:0'), '[0-9A-Fa-f]+', 'g')}, 'g', ''))"
    return f"({plain} or ({shape} and {groups} <= 7))"


def is_ip(d: Spark, v: str) -> str:
    return f"({is_ipv4(d, v)} or {is_ipv6(d, v)})"


def is_luhn(d: Spark, v: str, length: int) -> str:
    ok = d.matches(v, f"^[0-9]{{{length}}}$")
    return f"({ok} and {luhn_sum(d, f"case when {ok} then {v} else '1' end")} % 10 = 0)"


def is_iban(d: Spark, v: str) -> str:
    c = compact(d, v)
    ok = d.matches(c, "^[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}$")
    return d.let(f"case when {ok} then {c} else 'XX00' end", lambda x: f"(length({x}) > 4 and {iban_mod(d, x)} = 1)", "account")


def is_vat(d: Spark, v: str) -> str:
    c = compact(d, v)
    ok = d.matches(c, "^FR[0-9]{11}$")
    return d.let(f"case when {ok} then {c} else 'FR99000000000' end", lambda x: f"(cast(substr({x}, 3, 2) as int) = {vat_key(f'substr({x}, 5, 9)')})", "vat")


DETECTORS = {"is_email": is_email, "is_phone": is_phone, "is_ip": is_ip, "is_iban": is_iban, "is_vat": is_vat, "is_siren": lambda d, v: is_luhn(d, v, 9), "is_siret": lambda d, v: is_luhn(d, v, 14)}
