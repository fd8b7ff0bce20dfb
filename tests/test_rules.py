import json

import pytest
from pyspark.sql import functions as F

from maskwright.operators.anonymize import ColumnInfo, anonymize, column_infos, count_states, plan_table, transform
from maskwright.operators.check import check
from maskwright.operators.classify import classify, classify_name, starter_config, words_of
from maskwright.operators.unique import PoolExhausted, unique_mapping
from maskwright.plans import config as cfg
from maskwright.plans.report import Report, TableReport, plural, report, thousands

KEY = b"0123456789abcdef"


def test_grammar():
    c = cfg.parse('tables: {t: {a: keep, b: null, c: "null", no: \'constant("x y")\', e: {preset: date_shift, days: 3}, f: email}}')
    r = c.tables["t"]
    assert [r[k].kind for k in ("a", "b", "c", "no", "e", "f")] == ["keep", "null", "null", "constant", "preset", "preset"]
    assert r["no"].value == "x y" and dict(r["e"].params) == {"days": "3"}
    for bad in ("constant(x)", "two words", "[1]"):
        with pytest.raises(cfg.ConfigError):
            cfg.parse(f"tables: {{t: {{a: {bad}}}}}")


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("source: {kind: oracle}", "oracle"), ("defaults: {locale: en_US}", "en_US"), ("columns: {email: email}", "table.column"), ("tables: {t: {a: emial}}", "did you mean email"), ("tables: {t: {a: zzzzzzzz}}", "known:"),
        ("password: x", "password"), ("source: {kind: mysql, dsn: x}", "source.dsn"), ("columns: {a.b: email}\nexclude: [a.b]", "both"), ("mode: pseudonymize", cfg.KEY_VARIABLE), ("mode: other", "mode"),
    ],
)
def test_refused(text, says):
    with pytest.raises(cfg.ConfigError, match=says):
        cfg.parse(text, env={})


def test_globs_and_precedence():
    assert cfg.pattern_matches("*.email", "user", "email") and not cfg.pattern_matches("email", "user", "email")
    assert cfg.glob_match("a*c", "ac") and cfg.glob_match("*", "") and not cfg.glob_match("A", "a") and not cfg.glob_match("a.c", "abc")
    c = cfg.parse("tables: {u: {a: keep}}\ncolumns: {'*.a': email, '*.b*': hash, '*.b': city}\nreview: {'*.r': city}\nexclude: ['x.*']")
    assert [c.rule_for(*k) and c.rule_for(*k).value for k in (("u", "a"), ("v", "a"), ("u", "b"), ("u", "r"), ("x", "q"), ("u", "q"))] == ["", "email", "hash", "city", "", None]
    assert c.decisions_for("x", "r") == ["review", "exclude"] and c.unused_patterns([("u", "a")]) == [("*.b*", "columns"), ("*.b", "columns"), ("*.r", "review"), ("x.*", "exclude")]
    legacy = cfg.parse("review: ['u.a']")
    assert legacy.rule_for("u", "a") is None and legacy.review == {"u.a": None}


@pytest.fixture
def people(spark):
    rows = [(1, "a@b.fr", "Anne", "2020-01-01", 5), (2, None, "", None, None), (3, "", "Bob", "never", 7), (4, "a@b.fr", "Eve", "1999-12-31", 8)]
    return spark.createDataFrame(rows, "id int, email string, name string, born string, n int")


def test_rules_and_counters(people):
    config = cfg.parse("tables: {t: {email: email, name: 'constant(\"é\")', born: date_shift, n: 'null', id: hash}}")
    plan = plan_table("t", column_infos(people, {"email": ColumnInfo("email", max_len=10)}), config, {f.name: f.dataType for f in people.schema.fields})
    assert len(plan.warnings) == 1
    rows = sorted(transform(people, plan, KEY).collect())
    assert [r.id for r in rows] == [1, 2, 3, 4] and all(r.n is None for r in rows)
    assert rows[1].email is None and rows[2].email == "" and rows[0].email == rows[3].email and len(rows[0].email) == 10
    assert [r.name for r in rows] == ["é"] * 4 and rows[2].born == "never"
    got = {r["column"]: r.asDict() for r in count_states(people, plan, KEY).collect()}
    assert [got["email"][k] for k in ("transformed", "null", "kept", "truncated")] == [2, 1, 1, 2]
    assert [got["born"][k] for k in ("transformed", "null", "unchanged")] == [2, 1, 1] and got["n"]["null"] == 4 and got["id"]["kept"] == 4
    for n in (1, 17):
        assert sorted(transform(people.repartition(n), plan, KEY).collect()) == rows


def test_null_on_not_null_and_skip(people):
    config = cfg.parse("tables: {t: {name: 'null'}}\nskip_tables: [s]\ndefaults: {on_unclassified: keep}")
    plan = plan_table("t", column_infos(people, {"name": ColumnInfo("name", nullable=False)}), config)
    assert {r.name for r in transform(people, plan, KEY).collect()} == {""}
    skipped = transform(people, plan_table("s", column_infos(people), config), KEY)
    assert skipped.count() == 0 and skipped.columns == people.columns


def test_guard_and_conflicts(people):
    with pytest.raises(cfg.ConfigError, match="t.email"):
        anonymize({"t": people}, cfg.parse(""), KEY)
    plan_table("t", [ColumnInfo("email", generated=True)], cfg.parse(""))
    with pytest.raises(cfg.ConfigError, match="columns and exclude"):
        plan_table("t", [ColumnInfo("email")], cfg.parse("columns: {'*.email': email}\nexclude: ['t.*']"))


def test_keys(people, monkeypatch):
    monkeypatch.setenv(cfg.KEY_VARIABLE, "k" * 16)
    text = "tables: {t: {email: email, name: keep, born: keep}}\nmode: "
    once = lambda mode: sorted(anonymize({"t": people}, cfg.parse(text + mode))["t"].collect())
    assert once("pseudonymize") == once("pseudonymize") and once("anonymize") != once("anonymize")


def test_unique(spark):
    values = spark.createDataFrame([(f"u{i % 60}@x.fr",) for i in range(120)] + [(None,), ("",)], "input string")
    rule = cfg.Rule("preset", "city")
    with pytest.raises(PoolExhausted):
        unique_mapping(values, rule, KEY, attempts=2)
    few = unique_mapping(values.where("input < 'u3'"), rule, KEY).collect()
    assert len(few) == len({r.output for r in few}) == len({r.input for r in few}) > 10
    again = unique_mapping(values.where("input < 'u3'").repartition(7), rule, KEY).collect()
    assert sorted(few) == sorted(again)
    df = values.withColumnRenamed("input", "email").withColumn("id", F.monotonically_increasing_id())
    plan = plan_table("t", column_infos(df, {"email": ColumnInfo("email", unique=True)}), cfg.parse("tables: {t: {email: email}}"))
    out = transform(df, plan, KEY, "s_").collect()
    assert len(out) == 122 and len({r.email for r in out}) == 62 and sum(r.s_email == "transformed" for r in out) == 120


def test_names():
    assert words_of("contactFirstName") == ["contact", "first", "name"] and words_of("userIP_v") == ["user", "ip", "v"] and words_of("EMAIL") == ["email"]
    assert classify_name("email_verified").score == 0 and classify_name("hotel").score == 0 and classify_name("tva_rate").score == 0
    assert classify_name("nickname").score == 0.5 and classify_name("holder_name").score == 0.9 and classify_name("filename").score == 0


def test_contents_and_check(spark):
    n = 30
    df = spark.createDataFrame([(f"x{i}@mail.fr", f"1{i}", '{"email": 1}', "long text " * 20 if i % 10 else f"{'0612345678':>120}", f"10.0.0.{i}") for i in range(n)], "a string, b string, c string, d string, e string")
    df = df.withMetadata("c", {"sql_type": "json"})
    found = classify({"t": df})
    assert [(found["t", c].score, found["t", c].preset) for c in "abcde"] == [(0.9, "email"), (0.0, None), (0.5, None), (0.5, None), (0.9, "ip")]
    result = check({"t": df}, cfg.parse("columns: {'*.a': email, 'gone.*': keep}\nreview: {'t.c': 'null'}"))
    assert not result.ok and [c for _, c, _ in result.missing] == ["e"] and [c for _, c, _ in result.review] == ["d"]
    assert result.pending == ["t.c"] and result.unused == [("gone.*", "columns")] and "t.e" in result.text()
    assert check({"t": df}, cfg.parse("exclude: ['t.*']")).ok
    made = starter_config({(f"t{i}", c): classify_name(c) for i in range(3) for c in ("email", "birthdate", "nickname")})
    c = cfg.parse(made.yaml)
    assert c.columns["*.email"].value == "email" and dict(c.columns["*.birthdate"].params) == {"days": "365"} and list(c.review) == ["*.nickname"]
    assert (made.rules, made.to_review) == (2, 1)


def test_report(people):
    plan = plan_table("t", column_infos(people), cfg.parse("tables: {t: {email: email, name: keep, born: keep}}"))
    got = report("anonymize", {"t": (people, plan), "s": (people, plan_table("s", column_infos(people), cfg.parse("skip_tables: [s]")))}, KEY)
    text = got.text() + got.text(True) + got.to_json()
    assert got.tables["t"].rows_out == 4 and got.tables["s"].rows_out == 0 and "skipped" in text and "a@b.fr" not in text
    assert json.loads(got.to_json())["tables"]["t"]["columns"]["email"]["transformed"] == 2
    assert thousands(1234567) == "1 234 567" and plural(1, "table") == "table" and plural(2, "table") == "tables"
    assert "untouched" in Report("m", {"x": TableReport(1, 1)}).text()
