"""A relation of persons derived from ``customer``, the same in Spark and DuckDB: what the presets and detectors are tried on."""

from __future__ import annotations

from maskwright.functions.presets import _padded, iban_mod, luhn_digit, vat_key
from maskwright.functions.seed import Duck, Spark


def people_sql(d: Spark) -> str:
    """``id, email, first_name, ..., postcode``; null where id is a multiple of 11, else empty where it is one of 13."""
    i = "c_custkey"
    pad = lambda x, n: _padded(x, n)
    base = pad(f"({i} * 7919 + 10000019) % 100000000", 8)
    siren = d.let(base, lambda b: f"concat({b}, {luhn_digit(b, 8)})", "b8")
    siret = d.let(f"concat({siren}, {pad(f'{i} % 10000', 4)})", lambda b: f"concat({b}, {luhn_digit(b, 13)})", "b13")
    bban = f"concat({pad(f'{i} * 31 % 100000', 5)}, {pad(f'{i} * 17 % 100000', 5)}, 'A', {pad(f'{i} * 104729 % 1000000000', 10)}, {pad(f'{i} % 89', 2)})"
    iban = d.let(bban, lambda b: f"concat('FR', {_padded(f"98 - {iban_mod(d, f"concat('FR00', {b})")}", 2)}, {b})", "bb")
    columns = {
        "email": f"concat('user', cast({i} as string), case when {i} % 5 = 0 then ' at ' else '@' end, 'mail.example.com')",
        "first_name": f"concat('Prenom', cast({i} % 97 as string))",
        "last_name": f"concat('Nom', cast({i} % 89 as string))",
        "phone": f"case {i} % 3 when 0 then concat('+33 6', {pad(f'{i} % 100000000', 8)}) when 1 then concat('06', {pad(f'{i} % 100000000', 8)}) else concat('  +336', {pad(f'{i} % 100000000', 8)}) end",
        "birth_date": f"case when {i} % 7 = 0 then '0000-00-00' when {i} % 9 = 0 then concat('1949-', cast(1 + {i} % 12 as string), '-', cast(1 + {i} % 31 as string)) else concat(cast(1940 + {i} % 70 as string), '-', {pad(f'1 + {i} % 12', 2)}, '-', {pad(f'1 + {i} % 28', 2)}) end",
        "iban": f"case when {i} % 17 = 0 then 'FR76' when {i} % 4 = 0 then concat(substr({iban}, 1, 4), ' ', substr({iban}, 5)) else {iban} end",
        "bic": f"case {i} % 4 when 0 then 'AGRIFRPP' when 1 then 'BNPADEFFXXX' when 2 then 'SHORT' else 'CRLYESMMXXX' end",
        "siren": f"case when {i} % 4 = 0 then concat(substr({siren}, 1, 3), ' ', substr({siren}, 4, 3), ' ', substr({siren}, 7, 3)) when {i} % 19 = 0 then '12' else {siren} end",
        "siret": f"case when {i} % 23 = 0 then 'none' else {siret} end",
        "vat": f"case when {i} % 29 = 0 then 'BE 0123.456.789' when {i} % 4 = 0 then {d.let(siren, lambda x: f"concat('FR ', {_padded(vat_key(x), 2)}, ' ', {x})", 's')} else {d.let(siren, lambda x: f"concat('FR', {_padded(vat_key(x), 2)}, {x})", 's')} end",
        "ip": f"case {i} % 3 when 0 then '2a01:cb00:1234::1' when 1 then concat('10.0.', cast({i} % 256 as string), '.7') else concat('10.0.', cast({i} % 300 as string), '.', cast({i} % 256 as string)) end",
        "address": f"concat(cast({i} % 90 as string), ' rue Haute')",
        "city": f"concat('Ville', cast({i} % 40 as string))",
        "postcode": f"case when {i} % 31 = 0 then 'é1000' else {pad(f'{i} % 95000', 5)} end",
    }
    nulls = lambda x: f"case when {i} % 11 = 0 then null when {i} % 13 = 0 then '' else {x} end"
    return f"select c_custkey as id, {', '.join(f'{nulls(x)} as {c}' for c, x in columns.items())} from customer"


SPARK_PEOPLE, DUCK_PEOPLE = people_sql(Spark()), people_sql(Duck())
PRESET_COLUMN = {
    "hash": "email", "email": "email", "first_name": "first_name", "last_name": "last_name", "full_name": "last_name", "phone": "phone", "date_shift": "birth_date", "iban": "iban",
    "bic": "bic", "address_line": "address", "city": "city", "postcode": "postcode", "ip": "ip", "siren": "siren", "siret": "siret", "vat": "vat",
}
