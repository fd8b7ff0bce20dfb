"""Presets against plain Python that shares nothing with their SQL: seeds by hmac, draws by slices of hex digits."""

import datetime
import hmac
import re

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.functions.lists import CITIES, FIRST_NAMES, LAST_NAMES, STREETS
from maskwright.plans.people import DUCK_PEOPLE
from maskwright.plans.queries import KEY

SMALL = "/root/testdata/sf0.001"


def seed(label, value):
    return hmac.new(KEY, f"{label}\0{value}".encode(), "sha256").hexdigest()


def draw(s, i, n):
    return int(s[12 * i : 12 * i + 12], 16) % n


def luhn(base):
    total = 0
    for i, c in enumerate(reversed(base)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return base + str(-total % 10)


def digits(v):
    return re.sub("[^0-9]", "", v)


def spread(v, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), v)


def siren_of(s):
    return luhn(f"{1 + draw(s, 0, 9)}{draw(s, 1, 10**7):07d}")


def siren(v):
    new = siren_of(seed("siren", digits(v)))
    return spread(v, new) if len(digits(v)) == 9 else new


def siret(v):
    own, d = seed("siret", digits(v)), digits(v)
    new = luhn(siren_of(seed("siren", d[:9]) if len(d) == 14 else own) + f"{draw(own, 2, 10**4):04d}")
    return spread(v, new) if len(d) == 14 else new


def slots(s):
    import hashlib

    both = s + hashlib.sha256(f"{s}#1".encode()).hexdigest()
    return [int(both[4 * i : 4 * i + 4], 16) for i in range(32)]


def vat(v):
    if re.fullmatch("FR[0-9]{11}", re.sub(r"\s", "", v)):
        new = siren_of(seed("siren", digits(v)[2:11]))
        return spread(v, f"{(12 + 3 * (int(new) % 97)) % 97:02d}{new}")
    w = slots(seed("vat", digits(v)))
    return "".join(str(w[i % 32] % 10) if c.isdigit() else c for i, c in enumerate(v))


def iban(v):
    c = re.sub(r"\s", "", v)
    if len(c) < 8:
        return v
    w = slots(seed("iban", v))
    bban = "".join(chr(65 + w[i % 32] % 26) if x.isalpha() else str(w[i % 32] % 10) for i, x in enumerate(c[4:]))
    rest = int("".join(str(int(x, 36)) for x in bban + c[:2] + "00")) % 97
    return f"{c[:2]}{98 - rest:02d}{bban}"


def bic(v):
    if len(v) not in (8, 11):
        return v
    w = slots(seed("bic", v))
    letters = lambda *at: "".join(chr(65 + w[i - 1] % 26) for i in at)
    return letters(1, 2, 3, 4) + v[4:6] + letters(5, 6) + (letters(7, 8, 9) if len(v) == 11 else "")


def date_shift(v):
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})((?: .*)?)", v)
    if not m or not (1 <= int(m[1]) <= 9998 and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31):
        return v
    day = datetime.date(int(m[1]), int(m[2]), 1) + datetime.timedelta(int(m[3]) - 1 + draw(seed("date_shift", v), 0, 731) - 365)
    return f"{day:%Y-%m-%d}{m[4]}"


def phone(v):
    s = seed("phone", v)
    first, rest = 6 + draw(s, 0, 2), f"{draw(s, 1, 10**8):08d}"
    return f"+33 {first} {rest[:2]} {rest[2:4]} {rest[4:6]} {rest[6:]}" if v.lstrip().startswith("+") else f"0{first}{rest}"


def ip(v):
    s = seed("ip", v)
    return "2001:0db8:" + ":".join(s[4 * i : 4 * i + 4] for i in range(6)) if ":" in v else f"203.0.113.{1 + draw(s, 0, 253)}"


def email(v):
    s = seed("email", v)
    return f"{FIRST_NAMES[draw(s, 0, len(FIRST_NAMES))].lower()}.{LAST_NAMES[draw(s, 1, len(LAST_NAMES))].lower()}.{s[24:30]}@example.org"


PLAIN = {
    "preset_hash": ("email", lambda v: seed("hash", v)), "preset_email": ("email", email), "preset_phone": ("phone", phone), "preset_iban": ("iban", iban), "preset_bic": ("bic", bic),
    "preset_siren": ("siren", siren), "preset_siret": ("siret", siret), "preset_vat": ("vat", vat), "preset_ip": ("ip", ip), "preset_date_shift": ("birth_date", date_shift),
    "preset_first_name": ("first_name", lambda v: FIRST_NAMES[draw(seed("first_name", v), 0, len(FIRST_NAMES))]),
    "preset_city": ("city", lambda v: CITIES[draw(seed("city", v), 0, len(CITIES))][0]),
    "preset_address_line": ("address", lambda v: f"{1 + draw(s := seed('address_line', v), 0, 199)} {STREETS[draw(s, 1, len(STREETS))]}"),
}


@pytest.fixture(scope="module")
def persons():
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{SMALL}/customer.parquet'")
    return db.execute(DUCK_PEOPLE).fetch_df().astype(object)


@pytest.mark.parametrize("name", PLAIN)
def test_preset(spark, persons, name):
    column, plain = PLAIN[name]
    want = {r["id"]: v if not (v := r[column]) or v != v else plain(v) for _, r in persons.iterrows()}
    got = {r["id"]: r[column] for r in entry.queries()[name](spark, SMALL).collect()}
    assert {k: v or None for k, v in got.items()} == {k: v if isinstance(v, str) and v else None for k, v in want.items()}
    assert sum(v != r for v, r in zip(got.values(), persons[column], strict=True)) > 80
