"""Which columns look personal: by name, by a sample of values, and both together; the starter config drawn from that."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.detect import DETECTORS
from maskwright.functions.seed import Spark
from maskwright.plans.config import Config

MANDATORY, REVIEW = 0.8, 0.4
SAMPLES = 200
#: A name with one rule in so many tables, and in all that have it, is written as a pattern.
GROUPED = 3


@dataclass(frozen=True)
class Classification:
    score: float = 0.0
    preset: str | None = None
    reason: str = ""

    @property
    def mandatory(self) -> bool:
        return self.score >= MANDATORY

    @property
    def review(self) -> bool:
        return self.score >= REVIEW


METADATA = set("at count enabled id ids status type uuid verified".split())
TECHNICAL = set("browser bucket class column database device dir domain event field file host index job method module package path queue role route schema server service table template type".split())
#: In order, the first that fits decides: preset, words (or sequences of words), beginnings and ends of a word, reason.
NAMES: list[tuple[str, str, str, str, str]] = [
    ("email", "email mail courriel", "email courriel", "", "name"),
    ("first_name", "first_name given_name prenom", "firstname prenom", "", "name"),
    ("last_name", "last_name family_name surname nom", "lastname surname", "", "name"),
    ("phone", "phone tel mobile telephone", "phone telephone", "", "name"),
    ("iban", "iban bban account_number", "", "", "name"),
    ("bic", "bic swift", "", "", "name"),
    ("ip", "ip_address ip_addr remote_addr", "", "", "name"),
    ("address_line", "address adresse street rue line1 line2", "address adresse", "", "name"),
    ("city", "city ville town", "", "", "name"),
    ("postcode", "zip postcode postal_code code_postal", "zipcode postcode postalcode", "", "name"),
    ("date_shift", "dob", "birth naissance", "", "name (birth)"),
    ("null", "ssn nir secu social_security securite_sociale", "", "", "name"),
    ("null", "passwd pwd salt api_key secrets tokens", "password", "password token secret", "name (token)"),
    ("siret", "siret", "", "", "name"),
    ("siren", "siren", "", "", "name"),
    ("vat", "vat tva", "", "", "name"),
]
NOT_VAT = set("amount ht montant pct percent rate taux total ttc".split())


def words_of(name: str) -> list[str]:
    """Lower-case words of a column name: cut at ``_ - . space`` and before capitals, a run of which is one word."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return [w for w in re.split(r"[_\-. ]", split.lower()) if w]


def _has(words: list[str], sequences: str) -> bool:
    return any(words[i : i + len(s)] == s for s in (x.split("_") for x in sequences.split()) for i in range(len(words)))


def classify_name(name: str) -> Classification:
    w = words_of(name)
    last = w[-1] if w else ""
    if last in METADATA:
        return Classification()
    for preset, whole, starts, ends, reason in NAMES:
        if preset == "vat" and NOT_VAT & set(w):
            continue
        if _has(w, whole) or any(x.startswith(tuple(starts.split())) or x.endswith(tuple(ends.split())) for x in w) or (preset == "ip" and last == "ip"):
            return Classification(0.9, preset, reason)
    if _has(w, "body content") or any(x.startswith(("note", "comment", "message", "description")) for x in w):
        return Classification(0.5, None, "free text")
    technical = any(x == "name" and i and w[i - 1] in TECHNICAL or x.endswith("name") and x[:-4] in TECHNICAL for i, x in enumerate(w))
    hits = [] if technical else [s for s in ("name", "holder") if any(x.endswith(s) for x in w)]
    if hits:
        return Classification(min(0.9, 0.5 * len(hits)), "full_name", f"name ({' + '.join(hits)})")
    return Classification()


#: In order: detector, preset, reason.
CONTENTS = [("is_email", "email", "email"), ("is_iban", "iban", "IBAN"), ("is_siret", "siret", "SIRET"), ("is_siren", "siren", "SIREN"), ("is_vat", "vat", "VAT number"), ("is_phone", "phone", "phone"), ("is_ip", "ip", "IP")]
JSON_KEYS = "address email iban ip_address phone".split()


def samples(tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None, limit: int = SAMPLES) -> DataFrame:
    """``table, column, sql_type, value``: up to ``limit`` non-empty texts of each text column.

    With ``order`` (the columns a table is read in order of) the first of them, ranked in two steps: within each partition and then
    among the partitions' few, so no task ranks a whole column. Without it, what a scan of the table meets first.
    """
    parts = []
    for t, df in sorted(tables.items()):
        text = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not text:
            continue
        by = [F.col(f"`{c}`") for c in (order or {}).get(t, [])]
        for f in text:
            v = F.col(f"`{f.name}`")
            some = df.where(v.isNotNull() & (v != ""))
            some = (some.orderBy(*by) if by else some).limit(limit)
            parts.append(some.select(F.lit(t).alias("table"), F.lit(f.name).alias("column"), F.lit((f.metadata or {}).get("sql_type", "")).alias("sql_type"), v.alias("value")))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, sql_type string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_samples(values: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """The first ``limit`` rows by ``pos`` of each ``table, column`` of long-form ``table, column, sql_type, pos, value``.

    Of a rank filter Spark makes a limit of each group before the shuffle.
    """
    order = W.partitionBy("table", "column").orderBy("pos")
    return values.where("value <> ''").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n", "pos")


def first_texts(table: str, df: DataFrame, pos: str, columns: list[str], sql_type: str = "", limit: int = SAMPLES) -> DataFrame:
    """``table, column, sql_type, value``: what :func:`first_samples` takes of these columns, in order of the key ``pos``.

    Mostly a few of the first keys' rows have enough texts, and then only those rows' values are made or read. A column that they
    have too few texts of is read whole, and each task keeps its first ``limit``: none sorts or holds what it reads.
    """
    first = df.select(pos).where(F.col(pos).isNotNull()).orderBy(pos).limit(4 * limit).agg(F.max(pos)).first()[0]
    few = df.where(F.col(pos) <= F.lit(first))
    found = few.agg(*[F.count_if(F.col(c) != "").alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        some = (few if found[c] >= limit else df).where(F.col(c) != "").orderBy(F.col(pos).asc_nulls_last()).limit(limit)
        parts.append(some.select(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(sql_type).alias("sql_type"), F.col(c).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def content_ratios(values: DataFrame) -> DataFrame:
    """``table, column, n, avg_length, json_key, pii`` and a ratio for each detector, in one pass over sampled values."""
    d = Spark()
    ratio = lambda sql: F.round(F.avg(F.expr(sql).cast("double")), 6)
    json = F.lit(False)
    for k in JSON_KEYS:
        json = json | F.col("value").contains(f'"{k}"')
    return values.groupBy("table", "column", "sql_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.char_length("value")), 6).alias("avg_length"),
        F.bool_or(json).alias("json_key"),
        ratio(f"({DETECTORS['is_email'](d, 'value')}) or ({DETECTORS['is_phone'](d, 'value')})").alias("pii"),
        *[ratio(DETECTORS[name](d, "value")).alias(name) for name, _, _ in CONTENTS],
    )


def classify_content(ratios: DataFrame) -> DataFrame:
    """``table, column, score, preset, reason`` of :func:`content_ratios`."""
    struct = lambda score, preset, reason: F.struct(F.lit(score).alias("score"), F.lit(preset).cast("string").alias("preset"), F.lit(reason).alias("reason"))
    out = F.when((F.col("sql_type") == "json") & F.col("json_key"), struct(0.5, None, "JSON containing a sensitive key"))
    for name, preset, shown in CONTENTS:
        out = out.when(F.col(name) >= 0.8, struct(0.9, preset, f"content ({shown})"))
    out = out.when((F.col("avg_length") > 100) & (F.col("pii") >= 0.05), struct(0.5, None, "free text occasionally containing PII"))
    return ratios.select("table", "column", out.otherwise(struct(0.0, None, "")).alias("c")).select("table", "column", "c.*")


def classify(tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None, values: DataFrame | None = None) -> dict[tuple[str, str], Classification]:
    """All columns but generated ones, in order of table and column; content only counts where it scores higher than the name.

    ``values`` are samples taken already, as :func:`samples` has them.
    """
    names = {(t, f.name): classify_name(f.name) for t, df in tables.items() for f in df.schema.fields if not (f.metadata or {}).get("generated")}
    if tables:
        for r in classify_content(content_ratios(samples(tables, order) if values is None else values)).collect():  # a row for each column
            k = (r["table"], r["column"])
            if k in names and r["score"] > names[k].score:
                names[k] = Classification(r["score"], r["preset"], r["reason"])
    return dict(sorted(names.items()))


def missing_mandatory(found: dict[tuple[str, str], Classification], config: Config) -> list[tuple[str, str, Classification]]:
    return [(t, c, x) for (t, c), x in found.items() if x.mandatory and not config.exempt(t) and config.rule_for(t, c) is None]


def needs_review(found: dict[tuple[str, str], Classification], config: Config) -> list[tuple[str, str, Classification]]:
    return [(t, c, x) for (t, c), x in found.items() if x.review and not x.mandatory and not config.exempt(t) and config.rule_for(t, c) is None]


@dataclass
class StarterConfig:
    yaml: str
    rules: int
    to_review: int


def starter_config(found: dict[tuple[str, str], Classification]) -> StarterConfig:
    """A config to start from: sure columns with their presets, doubtful ones under review with a cautious rule."""
    count: dict[str, int] = defaultdict(int)
    for _, c in found:
        count[c] += 1
    rule = lambda x: "null" if x.preset in (None, "null") else "{ preset: date_shift, days: 365 }" if x.preset == "date_shift" else x.preset
    groups: dict[tuple[str, str, bool], list[tuple[str, Classification]]] = defaultdict(list)
    for (t, c), x in found.items():
        if x.review:
            groups[c, rule(x), not x.mandatory].append((t, x))
    exact: dict[str, list[str]] = defaultdict(list)
    lines: dict[bool, list[str]] = {True: [], False: []}
    grouped = {k: v for k, v in groups.items() if len(v) >= GROUPED and len(v) == count[k[0]] and not set(k[0]) & set('*."\\')}
    for (c, r, review), members in groups.items():
        for t, x in [] if (c, r, review) in grouped else members:
            if review:
                lines[True].append(f"  {t}.{c}: {r}  # {x.reason}")
            else:
                exact[t].append(f"    {c}: {r}  # {x.reason}")
    lines[True].sort()
    for (c, r, review), members in sorted(grouped.items()):
        lines[review].append(f'  "*.{c}": {r}  # {", ".join(sorted({x.reason for _, x in members}))} ({len(members)} tables)')
    block = lambda name, some: f"{name}:\n" + "\n".join(some) if some else f"{name}: {{}}"
    text = "\n\n".join([
        "version: 1", "source:\n  kind: mysql", "mode: anonymize", "defaults:\n  locale: fr_FR\n  on_unclassified: fail",
        "# Found with confidence.\n" + block("tables", [f"  {t}:\n" + "\n".join(sorted(v)) for t, v in sorted(exact.items())]),
        "# A rule for columns of many tables; * is any text. Lines decided on under review go here.\n" + block("columns", lines[False]),
        "# Columns to keep as they are.\nexclude: []",
        "# To decide: each line holds a cautious rule until it moves to columns, or its key to exclude.\n" + block("review", lines[True]),
    ])
    return StarterConfig(text + "\n", sum(map(len, exact.values())) + len(lines[False]), len(lines[True]))
