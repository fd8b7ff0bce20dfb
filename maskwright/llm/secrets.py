"""Secret scans over an incremental ledger of content-addressed blobs. Native: built-in expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, only


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and without overlaps; matches of which group ``group`` has under ``least`` letters are dropped.

    ``needs`` is a literal that each match holds, if there is one; a text without it is not searched.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The order is that of kinds at one start. The first three are the base. Where only the length of a run decides, it is part of the
#: pattern: inside a run that is too short there is no longer one.
RULES = (
    Rule("assign", 1, ASSIGN, 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,version:int>>"
#: Spans that are put together at a time: appending to a list copies it.
CHUNK = 256


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, rule: Rule, rank: int) -> str:
    """SQL for the spans of one rule in column ``text``, in code points from 0, end exclusive, in order.

    A match's place is the length of all that is before it: the pieces between matches and the matches. It is summed up in chunks,
    so that a long text full of matches takes no time beyond its length.
    """
    pattern = _quoted(rule.pattern)
    keep = f"char_length(regexp_extract(x.m, {pattern}, {rule.group})) >= {rule.least}" if rule.least else "true"
    start = "b.at + char_length(x.p)"
    span = f"named_struct('start', {start}, 'rank', {rank}, 'end', {start} + char_length(x.m), 'kind', {_quoted(rule.kind)}, 'version', {rule.version})"
    none = f"cast(array() as {SPAN})"
    chunk = f"aggregate(chunk, named_struct('at', acc.at, 'found', {none}), (b, x) -> named_struct('at', {start} + char_length(x.m), 'found', if({keep}, concat(b.found, array({span})), b.found)))"
    chunks = f"element_at(transform(array(split({text}, {pattern}, -1)), p -> transform(sequence(0, (size(m) - 1) div {CHUNK}), c -> zip_with(slice(p, c * {CHUNK} + 1, least({CHUNK}, size(m) - c * {CHUNK})), slice(m, c * {CHUNK} + 1, {CHUNK}), (p, m) -> named_struct('p', p, 'm', m)))), 1)"
    step = f"element_at(transform(array({chunk}), y -> named_struct('at', y.at, 'found', concat(acc.found, array(y.found)))), 1)"
    found = f"aggregate({chunks}, named_struct('at', 0, 'found', cast(array() as array<{SPAN}>)), (acc, chunk) -> {step}, acc -> flatten(acc.found))"
    some = f"contains({text}, {_quoted(rule.needs)})" if rule.needs else "true"
    return f"if({some}, element_at(transform(array(regexp_extract_all({text}, {pattern}, 0)), m -> if(size(m) = 0, {none}, {found})), 1), {none})"


def scan(paths: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows ``blob, rules array<string>, spans array<struct>`` for the blobs of ``paths(blob, text)``.

    Every blob is scanned once, however many paths have it, and only by rule versions for which the ledger has no row of it.
    A row also says that a scan found nothing. Of equal texts one is kept on the map side, before the shuffle.
    """
    todo = paths.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = todo.withColumn("rules", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0)
    each = [f"if(array_contains(rules, {_quoted(r.key)}), {_spans('text', r, n)}, cast(array() as {SPAN}))" if ledger is not None else _spans("text", r, n) for n, r in enumerate(rules)]
    return todo.select("blob", "rules", F.expr(f"array_sort(concat({', '.join(each)}))").alias("spans"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans``: what the ledger has of each blob by the given rule versions; a row of one scan may hold several."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    now = ledger.where(F.arrays_overlap("rules", keys))
    spans = F.filter("spans", lambda s: F.array_contains(keys, F.concat(s["kind"], F.lit("@"), s["version"].cast("string"))))
    return now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``, if there is one yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob string, rules array<string>, spans {SPAN}").parquet(path)


def _scanned(paths: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None, kept: str | None) -> tuple[DataFrame, DataFrame]:
    """``blob, spans`` of the blobs of ``paths``, and the ledger with what is new; with ``kept``, that is added to the one there."""
    ledger = stored(paths.sparkSession, kept) if kept else ledger
    new, _ = materialize(scan(paths, rules, ledger), "ledger")
    if kept:
        new.write.mode("append").parquet(kept)
    every = new if ledger is None else ledger.unionByName(new)
    return (new.select("blob", "spans") if ledger is None else findings(every, rules)), every


def scan_paths(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None, kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, blob, spans)`` for every row of ``docs``, and the ledger with this scan's rows.

    Rows may be versions of a document: with ``version_col`` the version comes back too. A ledger handed in, or kept at the path
    ``kept`` from run to run, makes only what is new be scanned: blobs it does not have, and rule versions it has not tried on them.
    Null texts are the empty blob; null ids, repeated rows and equal texts each get their row; an empty table gives none; other
    columns are not read.
    """
    names = [id_col] + ([version_col] if version_col else [])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    paths = only(docs, *names, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), *([F.col(f"`{version_col}`").alias("version")] if version_col else []), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    found, every = _scanned(paths, rules, ledger, kept)
    return paths.drop("text").join(found, "blob").select("doc_id", *(["version"] if version_col else []), "blob", "spans"), every


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, kept: str | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, each run of overlapping spans replaced by its first kind in brackets.

    With a ledger ``kept`` at a path, only blobs and rule versions that it does not have are scanned.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found, _ = _scanned(only(docs, text_col).select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")), rules, None, kept)
    hit = found.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    text = f"`{text_col}`"
    cut = f"""aggregate(_spans, named_struct('at', 0, 'out', ''), (acc, s) -> if(s.start >= acc.at,
        named_struct('at', s.end, 'out', concat(acc.out, substr({text}, acc.at + 1, s.start - acc.at), '[', s.kind, ']')),
        named_struct('at', greatest(acc.at, s.end), 'out', acc.out)), acc -> concat(acc.out, substr({text}, acc.at + 1)))"""
    clean = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.expr(cut))
    return keyed.join(hit, F.col("_key") == F.col("_blob"), "left").withColumn(text_col, clean).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by all rules, from an empty ledger."""
    found, _ = scan_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _duck(rule: Rule, rank: int) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    keep = f"length(regexp_extract(x, {pattern}, {rule.group})) >= {rule.least}" if rule.least else "true"
    at = "(acc.at + instr(substr(t, acc.at), x) - 1)"
    return f"""list_reduce(regexp_extract_all(t, {pattern}), lambda acc, x: {{'at': cast({at} + length(x) as bigint),
      'found': case when {keep} then list_append(acc.found, {{'start': cast({at} - 1 as bigint), 'rank': {rank}, 'end': cast({at} - 1 + length(x) as bigint), 'kind': '{rule.kind}'}}) else acc.found end}},
      {{'at': 1::bigint, 'found': []::struct("start" bigint, "rank" integer, "end" bigint, kind varchar)[]}}).found"""


SQL = {
    "op9_secrets": f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, list_sort(flatten([{", ".join(_duck(r, n) for n, r in enumerate(RULES))}])) as spans from d),
b as (select *, list_filter(spans, lambda s: s.kind in {BASE}) as base from s)
select doc_id, {", ".join(f"cast(len(list_filter(spans, lambda s: s.kind = '{k}')) as bigint) as n_{k}" for k in BASE)},
  sha256(array_to_string(list_transform(base, lambda s: concat_ws(':', s.kind, s.start, s."end")), ',')) as base_sha256,
  array_to_string(list_transform(spans, lambda s: concat_ws(':', s.kind, s.start, s."end")), ',') as spans
from b"""
}
