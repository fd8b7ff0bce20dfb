import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions.detect import DETECTORS
from maskwright.functions.presets import PRESETS, Preset, register_preset
from maskwright.functions.seed import Spark, seed_text
from maskwright.plans.config import Rule

D = Spark()


def run(spark, name, values, key=b"k" * 20, params=None):
    p = PRESETS[name]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    seeds = p.seeds(D, "v", key)
    seeded = df.select("i", "v", *[F.expr(s).alias(n) for n, s in seeds.items()])
    out = seeded.select("i", F.expr(p.build(D, "v", {n: n for n in seeds}, params or {})).alias("o")).collect()
    return [r.o for r in sorted(out)]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_seed_is_hmac(spark):
    for key in (b"short", b"x" * 64, b"y" * 90):
        for v in ("é", "it's \\", ""):
            sql = D.seed(key, "email", "v")
            got = spark.createDataFrame([(v,)], "v string").select(F.expr(sql)).first()[0]
            assert got == seed_text(key, "email", v) == hmac.new(key, b"email\0" + v.encode(), hashlib.sha256).hexdigest()


def test_shapes(spark):
    assert all(re.fullmatch(r"[0-9a-f]{64}", x) for x in run(spark, "hash", ["a", "b"]))
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+\.[0-9a-f]{6}@example\.org", x) for x in run(spark, "email", ["a", "b"]))
    a, b, c = run(spark, "phone", ["0612345678", "+33 6 12", "  +336"])
    assert re.fullmatch(r"0[67]\d{8}", a) and all(re.fullmatch(r"\+33 [67]( \d\d){4}", x) for x in (b, c))
    assert all(re.fullmatch(r"203\.0\.113\.\d+", x) for x in run(spark, "ip", ["1.2.3.4"])) and run(spark, "ip", ["::1"])[0].count(":") == 7
    short, eight, eleven = run(spark, "bic", ["X", "AGRIFRPP", "AGRIFRPPXXX"])
    assert short == "X" and re.fullmatch(r"[A-Z]{4}FR[A-Z]{2}", eight) and re.fullmatch(r"[A-Z]{4}FR[A-Z]{5}", eleven)
    kept, free = run(spark, "postcode", ["75001", "é"], params={"keep_department": "true"})
    assert re.fullmatch(r"75\d{3}", kept) and re.fullmatch(r"\d{5}", free)
    assert re.fullmatch(r"\d{1,3} .+", run(spark, "address_line", ["a"])[0]) and " " in run(spark, "full_name", ["a"])[0]


def test_checksums_and_links(spark):
    rng = random.Random(1)
    ibans = ["FR76" + "".join(rng.choice("0123456789ABZ") for _ in range(23)) for _ in range(50)] + ["DE89 3704 0044 0532 0130 00", "SHORT"]
    out = run(spark, "iban", ibans)
    assert out[-1] == "SHORT"
    for a, b in zip(ibans[:-1], out, strict=False):
        a = a.replace(" ", "")
        assert len(a) == len(b) and a[:2] == b[:2] and mod97(b) == 1
        assert all(x.isdigit() == y.isdigit() for x, y in zip(a[4:], b[4:], strict=True))
    sirens = ["732829320", "732 829 320", "12", "404833048"]
    s = run(spark, "siren", sirens)
    assert s[0] == s[1].replace(" ", "") and s[1][3] == " " and all(luhn(x.replace(" ", "")) and len(x.replace(" ", "")) == 9 for x in s)
    t = run(spark, "siret", ["73282932000074", "732 829 320 00074", "none"])
    assert t[0][:9] == s[0] and t[1].replace(" ", "") == t[0] and all(luhn(x.replace(" ", "")) for x in t)
    v = run(spark, "vat", ["FR44732829320", "FR 44 732829320", "BE 0123.456.789"])
    assert v[0][4:] == s[0] and v[0].startswith("FR") and int(v[0][2:4]) == (12 + 3 * (int(s[0]) % 97)) % 97
    assert v[1].replace(" ", "") == v[0] and re.fullmatch(r"BE \d{4}\.\d{3}\.\d{3}", v[2])


def test_dates(spark):
    values = ["2020-02-29", "1949-7-2", "2023-02-31", "2020-01-01 10:11:12", "0000-00-00", "2020-13-01", "x", "2020-01-01T00:00:00"]
    out = run(spark, "date_shift", values, params={"days": "0"})
    assert out == ["2020-02-29", "1949-07-02", "2023-03-03", "2020-01-01 10:11:12", "0000-00-00", "2020-13-01", "x", "2020-01-01T00:00:00"]
    moved = run(spark, "date_shift", [f"2000-01-{i:02d}" for i in range(1, 29)], params={"days": "3"})
    assert moved != [f"2000-01-{i:02d}" for i in range(1, 29)] and all("1999-12-29" <= x <= "2000-02-01" for x in moved)
    assert run(spark, "date_shift", ["2000-01-01"], params={"days": "-5"}) == ["2000-01-01"]
    assert run(spark, "date_shift", ["2000-01-01"], params={"days": "many"}) == run(spark, "date_shift", ["2000-01-01"])


def test_detectors(spark):
    cases = {
        "is_email": (["a@b.fr", " a@b.co.uk ", "a@b.c"], ["a@b", "@b.fr", "a@b.fr.", "a@.fr", "a b@c.fr", "a@b@c.fr", ""]),
        "is_phone": (["0612345678", "+33612345678", "06 12 34 56 78"], ["612345678", "+3312", "06123456789", "+33a12345678"]),
        "is_ip": (["1.2.3.4", "255.255.255.255", "::", "::1", "2a01:cb00:1234::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::"], ["1.2.3", "256.1.1.1", "01.2.3.4", "1:10", "12:30:00", "1:2:3:4:5:6", "1::2::3", "1:2:3:4:5:6:7::8:9", ":::"]),
        "is_iban": (["FR7630006000011234567890189", "DE89 3704 0044 0532 0130 00"], ["FR7630006000011234567890188", "FR76", "7630006000011234567890189"]),
        "is_siren": (["732829320"], ["732829321", "73282932", "73282932a"]),
        "is_siret": (["73282932000074"], ["73282932000075"]),
        "is_vat": (["FR44732829320", "FR 44 732 829 320"], ["FR45732829320", "BE0123456789"]),
    }
    for name, (yes, no) in cases.items():
        df = spark.createDataFrame([(v,) for v in yes + no], "v string")
        got = [r[0] for r in df.select(F.expr(DETECTORS[name](D, "v"))).collect()]
        assert got == [True] * len(yes) + [False] * len(no), (name, got)


def test_own_preset(spark):
    register_preset(Preset("loud", lambda d, v, s, p: f"upper({v})"))
    try:
        assert run(spark, "loud", ["a"]) == ["A"] and Rule("preset", "loud").value in PRESETS
    finally:
        del PRESETS["loud"]
