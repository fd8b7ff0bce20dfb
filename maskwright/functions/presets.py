"""The sixteen presets: a value and its seed in, a plausible value of the same kind out, as SQL text.

A builder takes the dialect, the value, its seeds by label and the parameters. Values are never null or empty here; what a preset
can't read (a short IBAN, an odd date) comes back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from maskwright.functions.lists import CITIES, FIRST_NAMES, LAST_NAMES, STREETS
from maskwright.functions.seed import Spark, draw

Seeds = dict[str, str]


def compact(d: Spark, v: str) -> str:
    return d.replaced(v, r"\s+", "")


def digits(d: Spark, v: str) -> str:
    return d.replaced(v, "[^0-9]", "")


def _padded(number: str, n: int) -> str:
    return f"lpad(cast({number} as string), {n}, '0')"


def luhn_digit(base: str, length: int) -> str:
    """The digit that completes ``length`` digits of text to a number of right Luhn sum."""
    terms = []
    for i in range(1, length + 1):
        digit = f"substr({base}, {i}, 1)"
        terms.append(f"cast(substr('0246813579', 1 + cast({digit} as int), 1) as int)" if (length - i) % 2 == 0 else f"cast({digit} as int)")
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 as string)"


def luhn_sum(d: Spark, v: str) -> str:
    """The Luhn sum of a text of digits."""
    digit = lambda i: f"cast(substr({v}, cast({i} as int), 1) as int)"
    doubled = lambda i: f"cast(substr('0246813579', 1 + {digit(i)}, 1) as int)"
    return d.folded(f"length({v})", "0", lambda acc, i: f"{acc} + case when (length({v}) - {i}) % 2 = 0 then {digit(i)} else {doubled(i)} end")


def iban_mod(d: Spark, v: str) -> str:
    """ISO 7064 mod 97-10 of a compact IBAN, country and check digits moved to the end."""
    turned = f"concat(substr({v}, 5), substr({v}, 1, 4))"

    def step(acc: str, i: str) -> str:
        c = f"{d.code(f'upper(substr({turned}, cast({i} as int), 1))')}"
        return f"case when {c} between 48 and 57 then ({acc} * 10 + {c} - 48) % 97 else ({acc} * 100 + {c} - 55) % 97 end"

    return d.folded(f"length({v})", "0", step)


def fake_siren(d: Spark, s: str) -> str:
    base = f"concat(cast(1 + {draw(d, s, 0, 9)} as string), {_padded(draw(d, s, 1, 10**7), 7)})"
    return d.let(base, lambda b: f"concat({b}, {luhn_digit(b, 8)})", "base8")


def _with_digits(d: Spark, v: str, new: str) -> str:
    """The letters of v, its digits replaced by those of new in turn."""
    at = f"substr({v}, cast(i as int), 1)"
    nth = f"cast(length({digits(d, f'substr({v}, 1, cast(i as int))')}) as int)"
    return d.let(new, lambda n: d.each(f"length({v})", lambda _: f"case when {d.matches(at, '[0-9]')} then substr({n}, {nth}, 1) else {at} end"), "new")


def _formatted(d: Spark, v: str, new: str, n: int) -> str:
    return f"case when length({digits(d, v)}) = {n} then {_with_digits(d, v, new)} else {new} end"


def _slots(d: Spark, s: str, one: Callable[[Callable[[str], str]], str]) -> str:
    """``one`` with the number of 16 bits in slot i (from 1, again from the start after 32) of 128 hex digits."""
    both = f"concat({s}, {d.sha(f"concat({s}, '#1')")})"
    return d.let(both, lambda b: one(lambda i: d.number(f"substr({b}, cast((({i} - 1) % 32) * 4 + 1 as int), 4)")), "hex128")


def hash_(d, v, s, p):
    return s["main"]


def email(d, v, s, p):
    first, last = (d.pick([x.lower() for x in items], draw(d, s["main"], i, len(items))) for i, items in enumerate((FIRST_NAMES, LAST_NAMES)))
    return f"concat({first}, '.', {last}, '.', substr({s['main']}, 25, 6), '@example.org')"


def first_name(d, v, s, p):
    return d.pick(FIRST_NAMES, draw(d, s["main"], 0, len(FIRST_NAMES)))


def last_name(d, v, s, p):
    return d.pick(LAST_NAMES, draw(d, s["main"], 0, len(LAST_NAMES)))


def full_name(d, v, s, p):
    return f"concat({d.pick(FIRST_NAMES, draw(d, s['main'], 0, len(FIRST_NAMES)))}, ' ', {d.pick(LAST_NAMES, draw(d, s['main'], 1, len(LAST_NAMES)))})"


def phone(d, v, s, p):
    prefix, rest = f"cast(6 + {draw(d, s['main'], 0, 2)} as string)", _padded(draw(d, s["main"], 1, 10**8), 8)
    spaced = ", ' ', ".join(f"substr({rest}, {i}, 2)" for i in (1, 3, 5, 7))
    return f"case when substr({d.replaced(v, r'^\s+', '')}, 1, 1) = '+' then concat('+33 ', {prefix}, ' ', {spaced}) else concat('0', {prefix}, {rest}) end"


def _date(d: Spark, v: str) -> str:
    """The date that a text begins with, up to the first space; null if there is none. Days beyond a month's end roll over."""
    date = f"split_part({v}, ' ', 1)"
    y, m, day = (d.integer(f"split_part({date}, '-', {i})") for i in (1, 2, 3))
    ok = f"{d.matches(date, '^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$')} and coalesce({y} between 1 and 9998 and {m} between 1 and 12 and {day} between 1 and 31, false)"
    # read only where ok: both engines may look at the branch all the same
    odd = f"case when {ok} then {d.day(f"cast(case when {ok} then {y} else 2000 end as int)", f"cast(case when {ok} then {m} else 1 end as int)", f"cast(case when {ok} then {day} else 1 end as int)")} end"
    return d.dated(date, odd)


def date_shift(d, v, s, p):
    days = max(0, _whole(p.get("days"), 365))
    moved = d.moved(s["date"], f"({draw(d, s['main'], 0, 2 * days + 1)} - {days})")
    return f"case when {s['date']} is null then {v} else concat({moved}, substr({v}, length(split_part({v}, ' ', 1)) + 1)) end"


def _mod_step(d: Spark, acc: str, ch: str) -> str:
    code = d.code(f"upper({ch})")
    return f"case when {code} between 48 and 57 then ({acc} * 10 + {code} - 48) % 97 else ({acc} * 100 + {code} - 55) % 97 end"


def iban(d, v, s, p):
    def made(c: str, slot) -> str:
        def new(i: str) -> str:  # the letter i of the account part
            old = f"substr({c}, cast({i} + 4 as int), 1)"
            return f"case when {d.matches(old, '[A-Za-z]')} then {d.letter(f'65 + {slot(i)} % 26')} else cast({slot(i)} % 10 as string) end"

        def checked(bban: str) -> str:  # by the remainder of account part, country, 00
            turned = lambda i: f"substr(concat({bban}, substr({c}, 1, 2), '00'), cast({i} as int), 1)"
            check = d.folded(f"length({c})", "0", lambda acc, i: _mod_step(d, acc, turned(i)))
            return f"concat(substr({c}, 1, 2), {_padded(f'98 - {check}', 2)}, {bban})"

        return d.let(d.each(f"length({c}) - 4", new), checked, "bban")

    c = compact(d, v)
    return f"case when length({c}) < 8 then {v} else {d.let(c, lambda x: _slots(d, s['main'], lambda slot: made(x, slot)), 'plain')} end"


def bic(d, v, s, p):
    def made(slot) -> str:
        letter = lambda i: d.letter(f"65 + {slot(str(i))} % 26")
        head, tail, branch = (", ".join(map(letter, r)) for r in (range(1, 5), range(5, 7), range(7, 10)))
        return f"concat({head}, substr({v}, 5, 2), {tail}, case when length({v}) = 11 then concat({branch}) else '' end)"

    return f"case when length({v}) in (8, 11) then {_slots(d, s['main'], made)} else {v} end"


def address_line(d, v, s, p):
    return f"concat(cast(1 + {draw(d, s['main'], 0, 199)} as string), ' ', {d.pick(STREETS, draw(d, s['main'], 1, len(STREETS)))})"


def city(d, v, s, p):
    return d.pick([c for c, _ in CITIES], draw(d, s["main"], 0, len(CITIES)))


def postcode(d, v, s, p):
    free = d.pick([c for _, c in CITIES], draw(d, s["main"], 0, len(CITIES)))
    if str(p.get("keep_department", "false")).lower() != "true":
        return free
    kept = f"concat(substr({v}, 1, 2), {_padded(draw(d, s['main'], 1, 1000), 3)})"
    return f"case when {d.matches(v, '^[ -~]{2}')} then {kept} else {free} end"


def ip(d, v, s, p):
    groups = ", ':', ".join(f"substr({s['main']}, {4 * i + 1}, 4)" for i in range(6))
    return f"case when instr({v}, ':') > 0 then concat('2001:0db8:', {groups}) else concat('203.0.113.', cast(1 + {draw(d, s['main'], 0, 253)} as string)) end"


def siren(d, v, s, p):
    return _formatted(d, v, fake_siren(d, s["main"]), 9)


def siret(d, v, s, p):
    base = f"concat(case when length({digits(d, v)}) = 14 then {fake_siren(d, s['linked'])} else {fake_siren(d, s['main'])} end, {_padded(draw(d, s['main'], 2, 10**4), 4)})"
    return d.let(d.let(base, lambda b: f"concat({b}, {luhn_digit(b, 13)})", "base13"), lambda n: _formatted(d, v, n, 14), "siret")


def vat_key(siren: str) -> str:
    return f"((12 + 3 * (cast({siren} as bigint) % 97)) % 97)"


def vat(d, v, s, p):
    french = d.let(fake_siren(d, s["linked"]), lambda n: _with_digits(d, v, f"concat({_padded(vat_key(n), 2)}, {n})"), "siren")
    at = f"substr({v}, cast(i as int), 1)"
    other = _slots(d, s["main"], lambda slot: d.each(f"length({v})", lambda i: f"case when {d.matches(at, '[0-9]')} then cast({slot(i)} % 10 as string) else {at} end"))
    return f"case when {d.matches(compact(d, v), '^FR[0-9]{11}$')} then {french} else {other} end"


def _whole(x, default: int) -> int:
    """A parameter of the wrong type counts as not given."""
    try:
        return default if x is None or isinstance(x, bool) else int(str(x))
    except ValueError:
        return default


def _text(d: Spark, v: str) -> str:
    return v


@dataclass(frozen=True)
class Preset:
    """``build`` makes the value. ``seeds`` says by label which preset's seed of which text it draws from.

    The text is what makes linked values agree: a SIRET and a VAT number hold the fake of the SIREN within, whatever separators.
    """

    name: str
    build: Callable[[Spark, str, Seeds, dict], str]
    main: Callable[[Spark, str], str] = _text
    linked: Callable[[Spark, str], str] | None = None
    date: Callable[[Spark, str], str] | None = None
    sample: str = "example"
    params: tuple[str, ...] = field(default=())

    def seeds(self, d: Spark, v: str, key: bytes, attempt: int = 0) -> Seeds:
        again = f"#{attempt}" if attempt else ""
        out = {"main": d.seed(key, self.name + again, self.main(d, v))}
        if self.linked:
            out["linked"] = d.seed(key, "siren" + again, self.linked(d, v))
        if self.date:  # not a seed, but like one: computed once, before the value
            out["date"] = self.date(d, v)
        return out


PRESETS: dict[str, Preset] = {}


def register_preset(preset: Preset) -> None:
    """Adds a preset, or puts one in the place of another."""
    PRESETS[preset.name] = preset


for _p in (
    Preset("hash", hash_),
    Preset("email", email),
    Preset("first_name", first_name),
    Preset("last_name", last_name),
    Preset("full_name", full_name),
    Preset("phone", phone, sample="0612345678"),
    Preset("date_shift", date_shift, date=_date, sample="2000-01-01", params=("days",)),
    Preset("iban", iban, sample="FR7630006000011234567890189"),
    Preset("bic", bic, sample="AGRIFRPPXXX"),
    Preset("address_line", address_line),
    Preset("city", city),
    Preset("postcode", postcode, sample="75001", params=("keep_department",)),
    Preset("ip", ip, sample="192.168.1.1"),
    Preset("siren", siren, digits, sample="732829320"),
    Preset("siret", siret, digits, lambda d, v: f"substr({digits(d, v)}, 1, 9)", sample="73282932000074"),
    Preset("vat", vat, digits, lambda d, v: f"substr({digits(d, v)}, 3, 9)", sample="FR44732829320"),
):
    register_preset(_p)
