"""The registry: each operator applied to whole tables, with the SQL that DuckDB gets the same rows from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.detect import DETECTORS
from maskwright.functions.presets import PRESETS
from maskwright.functions.seed import Duck, Spark
from maskwright.operators import classify
from maskwright.operators.anonymize import ColumnInfo, column_infos, count_states, plan_table, transform
from maskwright.operators.unique import unique_mapping
from maskwright.plans import config as cfg
from maskwright.plans.people import DUCK_PEOPLE, PRESET_COLUMN, SPARK_PEOPLE
from maskwright.plans.shared import spread

KEY = b"registry-demo-key-0001"
DUCK, SPARK = Duck(), Spark()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_PEOPLE.replace("from customer", "from {customer}"), customer=spread(table(spark, sf_dir, "customer").select("c_custkey")))


def _one_rule(df: DataFrame, column: str, rule: str, info: ColumnInfo | None = None) -> DataFrame:
    config = cfg.parse(f"tables: {{t: {{{column}: {rule}}}}}\ndefaults: {{on_unclassified: keep}}")
    return transform(df, plan_table("t", column_infos(df, {column: info} if info else None), config), KEY)


def duck_preset(name: str, column: str, source: str, params: dict | None = None, out: str | None = None, extra: str = "id") -> str:
    """DuckDB SQL for a preset on a text column: seeds first, then the value."""
    p = PRESETS[name]
    seeds = p.seeds(DUCK, column, KEY)
    inner = ", ".join(f"{sql} as seed_{label}" for label, sql in seeds.items())
    made = p.build(DUCK, column, {label: f"seed_{label}" for label in seeds}, params or {})
    return f"with src as ({source}), s as (select {extra}, {column}, {inner} from src) select {extra}, case when {column} is null or {column} = '' then {column} else {made} end as {out or column} from s"


def _preset(name: str, column: str) -> None:
    @query(f"preset_{name}", duck_preset(name, column, DUCK_PEOPLE))
    def run(spark, sf_dir):
        return _one_rule(people(spark, sf_dir).select("id", column), column, name)


for _name, _column in PRESET_COLUMN.items():
    _preset(_name, _column)


@query("postcode_keep_department", duck_preset("postcode", "postcode", DUCK_PEOPLE, {"keep_department": "true"}))
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "postcode"), "postcode", "{preset: postcode, keep_department: 'true'}")


@query("date_shift_days", duck_preset("date_shift", "birth_date", DUCK_PEOPLE, {"days": "10"}))
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "birth_date"), "birth_date", "{preset: date_shift, days: 10}")


@query("date_shift_time_suffix", duck_preset("date_shift", "seen", "select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as seen from events"))
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))
    return _one_rule(events, "seen", "date_shift")


@query("date_shift_typed", f"with m as ({duck_preset('date_shift', 'o', "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as o from orders")}) select id, o from m")
def _(spark, sf_dir):
    return _one_rule(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("o")), "o", "date_shift").withColumn("o", F.col("o").cast("string"))


@query("rule_keep", f"select id, email from ({DUCK_PEOPLE})")
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "email"), "email", "keep")


@query("rule_null", f"select id, cast(null as varchar) as email from ({DUCK_PEOPLE})")
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "email"), "email", "'null'")


@query("rule_null_not_null", f"select id, case when email is not null then '' end as email from ({DUCK_PEOPLE})")
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "email"), "email", "'null'", ColumnInfo("email", nullable=False))


@query("rule_constant", f"select id, case when email is not null then 'x y' end as email from ({DUCK_PEOPLE})")
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "email"), "email", "'constant(\"x y\")'", ColumnInfo("email", max_len=2))


@query("rule_truncate", f"select id, substr(email, 1, 12) as email from ({duck_preset('email', 'email', DUCK_PEOPLE)})")
def _(spark, sf_dir):
    return _one_rule(people(spark, sf_dir).select("id", "email"), "email", "email", ColumnInfo("email", max_len=12))


@query("rule_null_empty_laws", f"select count_if(email is null) as nulls, count_if(email = '') as empties, count(*) as n from ({DUCK_PEOPLE})")
def _(spark, sf_dir):
    out = _one_rule(people(spark, sf_dir).select("id", "email"), "email", "hash")
    return out.agg(F.count_if(F.col("email").isNull()).alias("nulls"), F.count_if(F.col("email") == "").alias("empties"), F.count("*").alias("n"))


_DIGITS = {c: f"regexp_replace({c}, '[^0-9]', '', 'g')" for c in ("siren", "siret", "vat")}
_LINKED_SQL = f"""select id, coalesce(length(a) = 9 and length(b) = 14 and substr(b, 1, 9) = a, false) as siret_linked, coalesce(length(a) = 9 and length(c) = 11 and substr(c, 3, 9) = a, false) as vat_linked,
    coalesce(siren <> '', false) as siren_ok, coalesce(siret <> '', false) as siret_ok, coalesce(vat like 'FR%' and length(c) = 11, false) as vat_ok
    from (select id, siren, siret, vat, {_DIGITS['siren']} as a, {_DIGITS['siret']} as b, {_DIGITS['vat']} as c from ({DUCK_PEOPLE}))"""


@query("siren_siret_vat_linked", _LINKED_SQL)
def _linked(spark, sf_dir):
    """Every person: fakes are linked just where the originals are, whatever the separators; null, empty or malformed values link
    nothing. The checksum of a fake is right wherever there was any text; French VAT numbers must be whole."""
    df = people(spark, sf_dir).select("id", "siren", "siret", "vat")
    config = cfg.parse("tables: {t: {siren: siren, siret: siret, vat: vat}}")
    out = transform(df, plan_table("t", column_infos(df), config), KEY)
    out = out.select("id", *[F.regexp_replace(x, "[^0-9]", "").alias(f"d_{x}") for x in ("siren", "siret", "vat")], "vat")
    linked = lambda x, at, n: F.coalesce((F.length("d_siren") == 9) & (F.length(x) == n) & (F.substring(x, at, 9) == F.col("d_siren")), F.lit(False))
    ok = lambda name, c: F.coalesce(F.expr(DETECTORS[name](SPARK, c)), F.lit(False))
    return out.select(
        "id", linked("d_siret", 1, 14).alias("siret_linked"), linked("d_vat", 3, 11).alias("vat_linked"),
        ok("is_siren", "d_siren").alias("siren_ok"), ok("is_siret", "d_siret").alias("siret_ok"), ok("is_vat", "vat").alias("vat_ok"),
    )


@query("siren_siret_vat_linked_all", f"select id, siret_linked, vat_linked from ({_LINKED_SQL})")
def _(spark, sf_dir):
    """The links alone."""
    return _linked(spark, sf_dir).select("id", "siret_linked", "vat_linked")


@query("fk_consistency", "select count(*) as pairs, count(distinct o_custkey) as customers from orders join customer on o_custkey = c_custkey")
def _(spark, sf_dir):
    a = _one_rule(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")), "k", "hash")
    b = _one_rule(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k")), "k", "hash")
    return b.join(a, "k").agg(F.count("*").alias("pairs"), F.count_distinct("k").alias("customers"))


_TOKENS = "select doc_id as id, unnest(string_split(text, ' ')) as token from documents"


def _detector(name: str, column: str) -> None:
    @query(name if name.startswith("is_") else name, f"select id, coalesce({DETECTORS[name](DUCK, column)}, false) as found from ({DUCK_PEOPLE})")
    def run(spark, sf_dir):
        return people(spark, sf_dir).select("id", F.coalesce(F.expr(DETECTORS[name](SPARK, column)), F.lit(False)).alias("found"))

    if name in ("is_email", "is_phone", "is_ip"):

        @query(f"{name}_tokens", f"select id, count(*) as n from ({_TOKENS}) where {DETECTORS[name](DUCK, 'token')} group by id")
        def run_tokens(spark, sf_dir):
            tokens = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", " ")).alias("token"))
            return tokens.where(DETECTORS[name](SPARK, "token")).groupBy("id").agg(F.count("*").alias("n"))


for _name, _column in {"is_email": "email", "is_phone": "phone", "is_ip": "ip", "is_iban": "iban", "is_vat": "vat", "is_siren": "siren", "is_siret": "siret"}.items():
    _detector(_name, _column)


_NUMBER = r"[+][0-9][0-9 ().-]{8,}[0-9]"
_DIALLED = "regexp_replace(number, '[^0-9+]', '', 'g')"


@query("is_phone_numbers", f"select id, count(*) as n from (select doc_id as id, unnest(regexp_extract_all(text, '{_NUMBER}')) as number from documents) where {DETECTORS['is_phone'](DUCK, _DIALLED)} group by id")
def _(spark, sf_dir):
    """International numbers as they are written in running text, punctuation taken out."""
    numbers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0))).alias("number"))
    return numbers.withColumn("number", F.regexp_replace("number", "[^0-9+]", "")).where(DETECTORS["is_phone"](SPARK, "number")).groupBy("id").agg(F.count("*").alias("n"))


@query("skip_table_empty", "select * from region where false")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return transform(df, plan_table("region", column_infos(df), cfg.parse("skip_tables: [region]")), KEY)


_SCHEMA = [("user", "email"), ("user", "first_name"), ("user", "note"), ("user", "email_hash"), ("order", "email"), ("order", "reference"), ("audit", "payload"), ("bank_account", "iban")]
_PATTERNS = ["*.email", "user.*", "*.e*l", "us*.note", "order", "*.*", "a%.p_yload", "bank_account.iban"]
_values = lambda rows: ", ".join("(" + ", ".join("null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query("generated_exempt", "select 'people' as t, 'email' as c, true as refused union all select 'people', 'email_domain', false")
def _(spark, sf_dir):
    out = []
    for c in (ColumnInfo("email"), ColumnInfo("email_domain", generated=True)):
        try:
            plan_table("people", [c], cfg.parse(""))
            out.append(("people", c.name, False))
        except cfg.ConfigError:
            out.append(("people", c.name, True))
    return spark.createDataFrame(out, "t string, c string, refused boolean")


@query("glob_match_matrix", f"""select p, t, c, instr(p, '.') > 0 and t like replace(replace(replace(split_part(p, '.', 1), '%', '\\%'), '_', '\\_'), '*', '%') escape '\\'
    and c like replace(replace(replace(substr(p, instr(p, '.') + 1), '%', '\\%'), '_', '\\_'), '*', '%') escape '\\' as hit
    from (values {_values([(p,) for p in _PATTERNS])}) a(p), (values {_values(_SCHEMA)}) b(t, c)""")
def _(spark, sf_dir):
    rows = [(p, t, c, cfg.pattern_matches(p, t, c)) for p in _PATTERNS for t, c in _SCHEMA]
    return spark.createDataFrame(rows, "p string, t string, c string, hit boolean")


_CONFIG = """
tables: {user: {email: email}}
columns: {"*.e*l": hash, "*.note": "null", "*.email*": keep}
review: {"*.iban": iban, "*.note": "null2"}
exclude: ["audit.*", "*.reference", "gone.*"]
""".replace('"null2"', '"null"').replace('"*.note": "null"}', '"order.ref*": city}')
_RULES = [(0, 0, "user", "email", "preset:email"), (1, 0, "%", "e%l", "preset:hash"), (1, 1, "%", "note", "null:"), (1, 2, "%", "email%", "keep:"), (2, 0, "%", "iban", "preset:iban"), (2, 1, "order", "ref%", "preset:city"), (3, 0, "audit", "%", "keep:"), (3, 1, "%", "reference", "keep:"), (3, 2, "gone", "%", "keep:")]
_RESOLVED = f"rules(prio, ord, tg, cg, rule) as (values {_values(_RULES)}), cols(t, c) as (values {_values(_SCHEMA)})"


@query("rule_resolution", f"with {_RESOLVED} select t, c, rule from (select *, row_number() over (partition by t, c order by prio, ord) as n from cols left join rules on t like tg and c like cg) where n = 1")
def _(spark, sf_dir):
    config = cfg.parse(_CONFIG)
    rows = [(t, c, f"{r.kind}:{r.value}" if (r := config.rule_for(t, c)) else None) for t, c in _SCHEMA]
    return spark.createDataFrame(rows, "t string, c string, rule string")


@query("rule_resolution_join", SQL["rule_resolution"])
def _(spark, sf_dir):
    """The same as a join of two relations, for schemas too large for the driver: the rules are the few lines of a config."""
    from pyspark.sql import Window as W

    cols = spark.createDataFrame(_SCHEMA, "t string, c string")
    rules = spark.createDataFrame([(p, o, t.replace("%", "*"), c.replace("%", "*"), r) for p, o, t, c, r in _RULES], "prio int, ord int, tg string, cg string, rule string")
    rules = rules.select("prio", "ord", *[F.replace(F.replace(F.replace(g, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%")).alias(g) for g in ("tg", "cg")], "rule")
    joined = cols.join(F.broadcast(rules), F.expr("t like tg and c like cg"), "left")
    return joined.withColumn("n", F.row_number().over(W.partitionBy("t", "c").orderBy("prio", "ord"))).where("n = 1").select("t", "c", "rule")


@query("conflicts", f"with {_RESOLVED} select t, c, count(distinct case prio when 0 then 1 else prio end) as decided from cols join rules on t like tg and c like cg group by t, c having count(distinct case prio when 0 then 1 else prio end) > 1")
def _(spark, sf_dir):
    config = cfg.parse(_CONFIG)
    rows = [(t, c, n) for t, c in _SCHEMA if (n := len(config.decisions_for(t, c))) > 1]
    return spark.createDataFrame(rows, "t string, c string, decided long")


@query("unused_patterns", f"with {_RESOLVED} select replace(tg, '%', '*') || '.' || replace(cg, '%', '*') as pattern from rules where prio > 0 and not exists (select 1 from cols where t like tg and c like cg)")
def _(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in cfg.parse(_CONFIG).unused_patterns(_SCHEMA)], "pattern string")


_NAMES = [
    ("email", 0.9, "email", "name"), ("contactFirstName", 0.9, "first_name", "name"), ("hotel", 0.0, None, ""), ("tel_portable", 0.9, "phone", "name"), ("nombre", 0.0, None, ""), ("nom", 0.9, "last_name", "name"),
    ("email_verified", 0.0, None, ""), ("address_id", 0.0, None, ""), ("birthdate", 0.9, "date_shift", "name (birth)"), ("accesstoken", 0.9, "null", "name (token)"), ("vat_rate", 0.0, None, ""), ("vatNumber", 0.9, "vat", "name"),
    ("notes", 0.5, None, "free text"), ("body", 0.5, None, "free text"), ("nickname", 0.5, "full_name", "name (name)"), ("holder_name", 0.9, "full_name", "name (name + holder)"), ("table_name", 0.0, None, ""), ("filename", 0.0, None, ""),
    ("client_ip", 0.9, "ip", "name"), ("ip", 0.9, "ip", "name"), ("siret", 0.9, "siret", "name"), ("siren", 0.9, "siren", "name"), ("iban", 0.9, "iban", "name"), ("swift", 0.9, "bic", "name"), ("code_postal", 0.9, "postcode", "name"),
    ("ville", 0.9, "city", "name"), ("line1", 0.9, "address_line", "name"), ("password", 0.9, "null", "name (token)"), ("social_security", 0.9, "null", "name"), ("EMAIL", 0.9, "email", "name"), ("userIP", 0.9, "ip", "name"), ("created_at", 0.0, None, ""), ("amount", 0.0, None, ""),
]


@query("classify_names", f"select name, cast(score as double) as score, preset, reason from (values {_values(_NAMES)}) n(name, score, preset, reason)")
def _(spark, sf_dir):
    rows = [(n, x.score, x.preset, x.reason) for n, *_ in _NAMES for x in [classify.classify_name(n)]]
    return spark.createDataFrame(rows, "name string, score double, preset string, reason string")


_LONG = {"people": ["email", "phone", "iban", "siren", "siret", "vat", "ip", "city"]}
_long_sql = " union all ".join(f"select 'people' as t, '{c}' as c, id as pos, {c} as value from people_" for c in _LONG["people"]) + " union all select 'documents', 'text', doc_id, text from documents union all select 'events', 'props', event_id, props from events"
_ratio_sql = ", ".join(f"round(avg(cast({DETECTORS[n](DUCK, 'value')} as integer)), 6) as {n}" for n, _, _ in classify.CONTENTS)
_json_sql = " or ".join(f"contains(value, '\"{k}\"')" for k in classify.JSON_KEYS)
_ratios = f"""with people_ as ({DUCK_PEOPLE}), long_ as ({_long_sql}),
    s as (select *, row_number() over (partition by t, c order by pos) as n from long_ where value <> ''),
    r as (select t, c, count(*) as n, round(avg(length(value)), 6) as avg_length, bool_or({_json_sql}) as json_key,
    round(avg(cast(({DETECTORS['is_email'](DUCK, 'value')}) or ({DETECTORS['is_phone'](DUCK, 'value')}) as integer)), 6) as pii, {_ratio_sql} from s where n <= {classify.SAMPLES} group by t, c)"""


def _ratio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.first_texts("people", people(spark, sf_dir), "id", _LONG["people"])
    docs = classify.first_texts("documents", table(spark, sf_dir, "documents"), "doc_id", ["text"])
    props = classify.first_texts("events", table(spark, sf_dir, "events"), "event_id", ["props"], "json")
    return classify.content_ratios(found.unionByName(docs).unionByName(props))


@query("content_ratios", _ratios + " select * from r")
def _(spark, sf_dir):
    return _ratio_rows(spark, sf_dir).drop("sql_type").withColumnsRenamed({"table": "t", "column": "c"})


_content_case = "case when c = 'props' and json_key then 0.5 " + " ".join(f"when {n} >= 0.8 then 0.9" for n, _, _ in classify.CONTENTS) + " when avg_length > 100 and pii >= 0.05 then 0.5 else 0.0 end"
_preset_case = "case when c = 'props' and json_key then null " + " ".join(f"when {n} >= 0.8 then '{p}'" for n, p, _ in classify.CONTENTS) + " end"


@query("classify_content", _ratios + f" select t, c, cast({_content_case} as double) as score, {_preset_case} as preset from r")
def _(spark, sf_dir):
    return classify.classify_content(_ratio_rows(spark, sf_dir)).select(F.col("table").alias("t"), F.col("column").alias("c"), "score", "preset")


@query("combine_scores", _ratios + f""", n(c, score, preset) as (values {_values([(c, x.score, x.preset) for c in [*_LONG['people'], 'text', 'props'] for x in [classify.classify_name(c)]])}),
    b as (select t, c, cast({_content_case} as double) as cs, {_preset_case} as cp from r)
    select t, b.c, cast(greatest(n.score, cs) as double) as score, case when cs > n.score then cp else n.preset end as preset from b join n on b.c = n.c""")
def _(spark, sf_dir):
    out = [(r["table"], r["column"], *((r["score"], r["preset"]) if r["score"] > (n := classify.classify_name(r["column"])).score else (n.score, n.preset))) for r in classify.classify_content(_ratio_rows(spark, sf_dir)).collect()]
    return spark.createDataFrame(out, "t string, c string, score double, preset string")


_FOUND = [(t, c, x) for t, c in [*_SCHEMA, ("user", "nickname"), ("user", "holder_name"), ("audit", "ip_address"), ("order", "customer_email"), ("skipped", "email"), ("order", "comment")] for x in [classify.classify_name(c)]]
_COVER = "tables: {user: {email: email}}\ncolumns: {'*.customer_*': email}\nexclude: ['*.comment']\nskip_tables: [skipped]"
_cover_sql = f"with f(t, c, score) as (values {_values([(t, c, x.score) for t, c, x in _FOUND])}), rules(tg, cg) as (values ('user', 'email'), ('%', 'customer\\_%'), ('%', 'comment')) select t, c from f where t <> 'skipped' and not exists (select 1 from rules where t like tg escape '\\' and c like cg escape '\\')"


@query("missing_mandatory", _cover_sql + " and score >= 0.8")
def _(spark, sf_dir):
    found = classify.missing_mandatory({(t, c): x for t, c, x in _FOUND}, cfg.parse(_COVER))
    return spark.createDataFrame([(t, c) for t, c, _ in found], "t string, c string")


@query("needs_review", _cover_sql + " and score >= 0.4 and score < 0.8")
def _(spark, sf_dir):
    found = classify.needs_review({(t, c): x for t, c, x in _FOUND}, cfg.parse(_COVER))
    return spark.createDataFrame([(t, c) for t, c, _ in found], "t string, c string")


_GROUPS = [(f"t{i}", c) for i in range(4) for c in ("email", "amount", *(["phone"] if i < 2 else []), *(["nickname"] if i else []))]


@query("init_grouping", f"with g(t, c, score, preset) as (values {_values([(t, c, x.score, x.preset) for t, c in _GROUPS for x in [classify.classify_name(c)]])}) select c, count(*) as n, min(preset) as preset from g where score >= 0.4 group by c having count(*) >= 3")
def _(spark, sf_dir):
    import yaml

    raw = yaml.safe_load(classify.starter_config({(t, c): classify.classify_name(c) for t, c in _GROUPS}).yaml)
    found = {p.split(".")[1]: r for s in ("columns", "review") for p, r in raw[s].items() if p.startswith("*")}
    return spark.createDataFrame([(c, sum(x == c for _, x in _GROUPS), r) for c, r in found.items()], "c string, n long, preset string")


_counted = duck_preset("email", "email", DUCK_PEOPLE)


def _counter_config(df):
    config = cfg.parse("tables: {people: {email: email, iban: 'null', bic: 'constant(\"x\")', city: keep, siren: siren}}\ndefaults: {on_unclassified: keep}")
    return plan_table("people", column_infos(df, {"email": ColumnInfo("email", max_len=30)}), config)


@query("report_counters", f"""with p as ({DUCK_PEOPLE}), e as ({duck_preset('email', 'email', DUCK_PEOPLE)}), s as ({duck_preset('siren', 'siren', DUCK_PEOPLE)}), n as (select count(*) as n, count_if(email is null) as nulls, count_if(email = '') as empties from p)
    select 'people' as "table", 'email' as "column", n - nulls - empties as transformed, nulls as "null", empties as kept, (select count(*) from e where length(email) > 30) as truncated, 0 as unchanged from n
    union all select 'people', 'iban', 0, n, 0, 0, 0 from n union all select 'people', 'bic', n - nulls, nulls, 0, 0, 0 from n
    union all select 'people', 'city', 0, 0, n, 0, 0 from n
    union all select 'people', 'siren', n - nulls - empties - u, nulls, empties, 0, u from n, (select count(*) as u from s join p using (id) where s.siren = p.siren and p.siren <> '')""")
def _(spark, sf_dir):
    df = people(spark, sf_dir).select("email", "iban", "bic", "city", "siren")
    return count_states(df, _counter_config(df), KEY)


@query("report_tables", f"select 'people' as t, count(*) as rows_in, count(*) as rows_out, 4 as touched from ({DUCK_PEOPLE}) union all select 'region', count(*), 0, 0 from region")
def _(spark, sf_dir):
    from maskwright.plans.report import report

    df, region = people(spark, sf_dir).select("email", "iban", "bic", "city", "siren"), table(spark, sf_dir, "region")
    skipped = plan_table("region", column_infos(region), cfg.parse("skip_tables: [region]"))
    got = report("anonymize", {"people": (df, _counter_config(df)), "region": (region, skipped)}, KEY)
    return spark.createDataFrame([(t, x.rows_in, x.rows_out, x.touched) for t, x in got.tables.items()], "t string, rows_in long, rows_out long, touched int")


_TYPOS = ["emial", "fone", "ibann", "adress_line", "zzzzzzzz", "sirte", "dateshift"]


@query("preset_suggestion", f"""select typo, case when min(levenshtein(typo, p)) <= 2 then arg_min(p, levenshtein(typo, p) * 100 + o) end as preset
    from (values {_values([(t,) for t in _TYPOS])}) a(typo), (values {_values([(p, i) for i, p in enumerate(PRESETS)])}) b(p, o) group by typo""")
def _(spark, sf_dir):
    return spark.createDataFrame([(t, cfg.suggestion(t)) for t in _TYPOS], "typo string, preset string")


@query("unique_email", f"select count(distinct email) as inputs, count(distinct email) as outputs, true as shaped from ({DUCK_PEOPLE}) where email <> ''")
def _(spark, sf_dir):
    m = unique_mapping(people(spark, sf_dir).select(F.col("email").alias("input")), cfg.Rule("preset", "email"), KEY)
    return m.agg(F.count_distinct("input").alias("inputs"), F.count_distinct("output").alias("outputs"), F.bool_and(F.col("output").rlike("^[a-z]+[.][a-z]+[.][0-9a-f]{6}@example[.]org$")).alias("shaped"))


@query("unique_tiny_pool", "select 200 as inputs, 200 as outputs")
def _(spark, sf_dir):
    m = unique_mapping(spark.range(200).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("input")), cfg.Rule("preset", "ip"), KEY)
    return m.agg(F.count_distinct("input").cast("int").alias("inputs"), F.count_distinct("output").cast("int").alias("outputs"))


@query("unique_column_rows", f"select id, email is null as is_null, email = '' as is_empty, true as changed from ({DUCK_PEOPLE})".replace("true as changed", "case when email <> '' then true else email = '' end as changed").replace("email = '' as is_empty", "coalesce(email = '', false) as is_empty").replace("case when email <> '' then true else email = '' end", "coalesce(email <> '', false)"))
def _(spark, sf_dir):
    df = people(spark, sf_dir).select("id", "email")
    out = _one_rule(df, "email", "email", ColumnInfo("email", unique=True)).withColumnRenamed("email", "made")
    both = df.join(out, "id")
    return both.select("id", F.col("made").isNull().alias("is_null"), F.coalesce(F.col("made") == "", F.lit(False)).alias("is_empty"), F.coalesce(F.col("made") != F.col("email"), F.lit(False)).alias("changed"))


@query("preset_catalog", " union all ".join(f"select '{p.name}' as preset, '{p.sample}' as sample, {PRESETS[p.name].build(DUCK, f"'{p.sample}'", p.seeds(DUCK, f"'{p.sample}'", b'presets-demo'), {})} as output" for p in PRESETS.values()))
def _(spark, sf_dir):
    return catalog(spark)


def catalog(spark: SparkSession) -> DataFrame:
    """``preset, sample, output`` with a fixed key."""
    base = spark.range(1)
    parts = [base.select(F.lit(p.name).alias("preset"), F.lit(p.sample).alias("sample"), F.expr(p.build(SPARK, SPARK.text(p.sample), p.seeds(SPARK, SPARK.text(p.sample), b"presets-demo"), {})).alias("output")) for p in PRESETS.values()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table of persons, every sensitive column replaced."""
    df = people(spark, sf_dir)
    rules = "\n".join(f"    {c}: {p}" for p, c in PRESET_COLUMN.items() if p not in ("hash", "full_name"))
    return transform(df, plan_table("people", column_infos(df), cfg.parse(f"tables:\n  people:\n{rules}\n")), KEY)


_flag = {c: p for p, c in PRESET_COLUMN.items() if p not in ("hash", "full_name")}
_seeds = {f"{c}_{label}": sql for c, p in _flag.items() for label, sql in PRESETS[p].seeds(DUCK, c, KEY).items()}
SQL["anonymize_people"] = (
    f"with src as ({DUCK_PEOPLE}), s as (select *, {', '.join(f'{sql} as s_{n}' for n, sql in _seeds.items())} from src) select id, "
    + ", ".join(f"case when {c} is null or {c} = '' then {c} else {PRESETS[p].build(DUCK, c, {label: f's_{c}_{label}' for label in ('main', 'linked', 'date')}, {})} end as {c}" for c, p in _flag.items())
    + " from s"
)
QUERIES["anonymize_people"] = flagship


def _customer_dump(spark: SparkSession, sf_dir: str) -> str:
    from maskwright.sources.generate import dump_of

    return dump_of(spark, {"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "nation": (table(spark, sf_dir, "nation"), "n_nationkey")}, lengths={"customer": {"c_name": 40}})


@query("dump_parse", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf_dir):
    from maskwright.sources.mysqldump import read_dump

    return read_dump(spark, _customer_dump(spark, sf_dir)).table("customer")


@query("dump_roundtrip", "select 'customer' as name, count(*) as n, true as same from customer union all select 'nation', count(*), true from nation")
def _(spark, sf_dir):
    from maskwright.plans.shared import shared_path
    from maskwright.sources.mysqldump import read_dump, write_dump

    path = _customer_dump(spark, sf_dir)
    one = read_dump(spark, path)
    write_dump(one.statements, again := shared_path(spark, "dump"))
    two = read_dump(spark, again)
    out = None
    for t in ("customer", "nation"):
        a, b = one.table(t), two.table(t)
        same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        row = b.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.lit(same).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


@query("dump_anonymize", f"with x as ({duck_preset('full_name', 'c_name', 'select * from customer', extra='c_custkey, c_nationkey, c_acctbal, c_mktsegment')}) select c_custkey, substr(c_name, 1, 40) as c_name, c_nationkey, c_acctbal, 'x' as c_mktsegment from x")
def _(spark, sf_dir):
    from maskwright.plans.shared import shared_path
    from maskwright.sources.mysqldump import anonymize_dump, read_dump, write_dump

    config = cfg.parse("tables: {customer: {c_name: full_name, c_mktsegment: 'constant(\"x\")'}}\nskip_tables: [nation]\ndefaults: {on_unclassified: keep}")
    write_dump(anonymize_dump(read_dump(spark, _customer_dump(spark, sf_dir)), config, KEY), out := shared_path(spark, "dump"))
    return read_dump(spark, out).table("customer")


def _people_dump(spark: SparkSession, sf_dir: str) -> str:
    from maskwright.sources.generate import dump_of

    return dump_of(spark, {"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "people": (people(spark, sf_dir), "id")})


def _command(spark: SparkSession, dump: str, config: str, *argv: str) -> tuple[int, dict[str, str], str]:
    """Runs the command line on a dump: its code, the small files it leaves on the driver, its shared folder."""
    import contextlib
    import io
    import os
    import tempfile

    from maskwright import cli
    from maskwright.plans.shared import shared_path

    with tempfile.TemporaryDirectory() as at, contextlib.redirect_stdout(io.StringIO()):
        with open(f"{at}/config.yaml", "w", encoding="utf-8") as f:
            f.write(config)
        out = shared_path(spark, "dump")
        names = {"CONFIG": f"{at}/config.yaml", "OUT": out, "MADE": f"{at}/made.yaml", "REPORT": f"{at}/report"}
        code = cli.main([argv[0], "--from", dump, *(names.get(x, x) for x in argv[1:])])
        files = {}
        for d, _, found in os.walk(at):
            for x in found:
                with open(f"{d}/{x}", encoding="utf-8") as f:
                    files[x] = f.read()
    return code, files, out


@query("cmd_transform", "select c_custkey, 'x' as c_name, c_nationkey, c_acctbal, cast(null as varchar) as c_mktsegment from customer")
def _(spark, sf_dir):
    from maskwright.sources.mysqldump import read_dump

    config = "tables: {customer: {c_name: 'constant(\"x\")', c_mktsegment: 'null'}}\nskip_tables: [people]\ndefaults: {on_unclassified: keep}"
    code, _, out = _command(spark, _people_dump(spark, sf_dir), config, "transform", "--config", "CONFIG", "--out", "OUT", "--report", "REPORT")
    if code:
        raise RuntimeError(f"transform ended with {code}")
    return read_dump(spark, out).table("customer")


@query("cmd_check", f"select * from (values {_values([('people missing', 1), ('people covered', 0), ('review', 1), ('conflict', 1)])}) c(config, code)")
def _(spark, sf_dir):
    """The exit codes of check: 1 where a sensitive column has no rule, an entry is under review or two sections decide."""
    every = ", ".join(f"{c}: {p}" for p, c in PRESET_COLUMN.items() if p not in ("hash", "full_name"))
    configs = {
        "people missing": "tables: {people: {email: email}}\nexclude: ['customer.*']",
        "people covered": f"tables: {{people: {{{every}}}}}\nexclude: ['customer.*']",
        "review": f"tables: {{people: {{{every}}}}}\nexclude: ['customer.*']\nreview: {{'*.x': hash}}",
        "conflict": f"tables: {{people: {{{every}}}}}\nexclude: ['customer.*', 'people.email']",
    }
    dump = _people_dump(spark, sf_dir)
    return spark.createDataFrame([(n, _command(spark, dump, c, "check", "--config", "CONFIG")[0]) for n, c in configs.items()], "config string, code int")


_STARTED = [(c, p) for p, c in PRESET_COLUMN.items() if p not in ("hash", "full_name")]


@query("cmd_init", f"select * from (values {_values(_STARTED)}) r(c, rule)")
def _(spark, sf_dir):
    """What init proposes for the columns of the table of persons, by name and content."""
    import yaml

    code, files, _ = _command(spark, _people_dump(spark, sf_dir), "", "init", "--out", "MADE")
    if code:
        raise RuntimeError(f"init ended with {code}")
    raw = yaml.safe_load(files["made.yaml"])
    rows = [*(raw.get("tables") or {}).get("people", {}).items(), *((p.split(".")[-1], r) for s in ("columns", "review") for p, r in (raw.get(s) or {}).items() if p.startswith(("people.", "*.")))]
    return spark.createDataFrame([(c, r if isinstance(r, str) else r["preset"]) for c, r in rows], "c string, rule string")


@query("stream_anonymize", SQL["preset_email"])
def _(spark, sf_dir):
    from maskwright.plans.shared import shared_path, written
    from maskwright.streaming.files import run_available

    source = shared_path(spark, "in")
    people(spark, sf_dir).select("id", "email").write.parquet(source)
    out = run_available(spark, source, shared_path(spark, "out"), "t", cfg.parse("tables: {t: {email: email}}"), KEY)
    return written(out, "streamed")


@query("generated_shop", "select 'customers' as name, 1500 as n union all select 'orderdetails', 12000 union all select 'orders', 3000 union all select 'payments', 3000 union all select 'user', 750")
def _(spark, sf_dir):
    from maskwright.sources.generate import dump_of, shop
    from maskwright.sources.mysqldump import read_dump

    dump = read_dump(spark, dump_of(spark, shop(spark, 1500)))
    out = None
    for t in sorted(dump.tables):
        row = dump.table(t).agg(F.lit(t).alias("name"), F.count("*").cast("int").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
