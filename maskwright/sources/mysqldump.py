"""MySQL dumps as DataFrames, and back.

A dump is read in records that end where a semicolon ends a line, by Spark's text source, so large files are read in parallel by
any path Spark knows. Dump programs write newlines in strings as escapes, so a block of a file mostly begins and ends between
statements. Where one does not (a string that holds such an end of line), each block is read for all it may begin within, which
settles in what each does begin; only the pieces of statements that go over blocks are then put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.anonymize import plan_table, transform
from maskwright.operators.classify import SAMPLES, first_samples
from maskwright.plans.config import KEEP, Config, resolve_key
from maskwright.plans.shared import dropped, shared_path, written
from maskwright.sources import mysqltext as text

#: Where a statement is: files in order of name, blocks in order of place, records and statements in order of reading.
PLACE = ["file", "block", "record", "part"]
#: The kind of a piece of a statement that goes over blocks, and the part of all but its first.
PIECE, LATER = "piece", 2**31 - 1
STATEMENT = "file string, block long, record long, part int, kind string, table string, raw binary"


def _row(at: tuple, part: int, statement: bytes) -> tuple:
    kind, table = text.kind_of(statement)
    return (*at, part, kind, table, statement)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


#: A batch that is handed on ends at so many rows, or bytes of statements or values.
ROWS, BYTES = 2000, 4 << 20


def _each(b: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, made one at a time: ten thousand whole statements, or as many lists of their rows, are not held as objects."""
    return (tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows))


def _batches(rows: Iterable[tuple[int, tuple]], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``bytes, row``, each of ROWS or of about BYTES at most."""
    some, size = [], 0
    for n, row in rows:
        some.append(row)
        size += n
        if len(some) >= ROWS or size >= BYTES:
            yield _batch(some, schema)
            some, size = [], 0
    yield _batch(some, schema)


_ARROW = [("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("table", pa.string()), ("raw", pa.binary())]


def _ended(left: bytes) -> bytes:
    """What is left of a record, with the end that the reader took off; after the last statement there is none."""
    return left + b";\n" if re.sub(rb"(?m)^\s*(?:--(?:\s|$)|#)[^\n]*$", b"", left).strip() else left


class _Block:
    """Cuts the records of a block into statements; ``within`` is what the block begins in."""

    def __init__(self, within: bytes = b""):
        self.held, self.within = within, within

    def feed(self, value: bytes, final: bool, last: bool) -> list[bytes]:
        """Statements that end in this record. The first may be the end of one that began before the block.

        The reader took off what ends a record. Only the ``final`` record of a block may have had none, at the end of the file: then
        only comments are left, by whole lines, or in the ``last`` block of the file.
        """
        if not final:
            done, self.held = text.split_statements(self.held + value + b";\n")
            return done
        done, left = text.split_statements(self.held + value)
        more, self.held = text.split_statements(_ended(left) if last else left + b";\n") if left else ([], b"")
        return done + more


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, bool, bool]]:
    """``(file, block), record, value, final, last`` of a partition; final: of its block."""
    before = None
    for b in batches:
        for f, at, record, value, last in _each(b):
            if before:
                yield *before[:3], before[0] != (f, at), before[3]
            before = ((f, at), record, value, last)
    if before:
        yield *before[:3], True, before[3]


def _in_blocks(batches: Iterator[pa.RecordBatch], within: dict) -> Iterator[tuple]:
    """``(key, record, statements, block)`` for each record, and ``(key, None, [], block)`` at each block's end, of a partition's batches."""
    block = None
    for key, record, value, final, last in _records(batches):
        block = block or _Block(within.get(key, (b"",))[0])
        yield key, record, block.feed(value, final, last), block
        if final:
            yield key, None, [], block
            block = None


def _unsettled(records: DataFrame) -> dict[tuple[str, int], tuple[bytes, int]]:
    """What each block begins within, and in which block that statement began, where that is not between statements.

    The driver gets rows for files only that have such a block: one for each block, as it has for each file split anyway.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [k[0] for k, record, _, block in _in_blocks(batches, {}) if record is None and text.open_at_end(block.held)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])

    odd = [r[0] for r in records.mapInArrow(ends, "file string").distinct().collect()]
    if not odd:
        return {}

    def all_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, runs, ended = [], [], []
        for key, _, value, final, last in _records(batches):
            if not runs:
                runs, ended = [_Block(o) for o in text.OPENERS], [False] * len(text.OPENERS)
            ended = [bool(r.feed(value, final, last)) or e for r, e in zip(runs, ended, strict=True)]
            if final:
                rows.append((*key, [text.open_at_end(r.held) for r in runs], ended))
                runs = []
        yield _batch(rows, [("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.binary())), ("ended", pa.list_(pa.bool_()))])

    out: dict[tuple[str, int], tuple[bytes, int]] = {}
    file, state, owner = None, b"", 0
    some = records.where(F.col("file").isin(odd)).mapInArrow(all_ends, "file string, block long, ends array<binary>, ended array<boolean>")
    for r in some.orderBy("file", "block").collect():
        if r.file != file:
            file, state = r.file, b""
        if state:
            out[r.file, r.block] = (state, owner)
        n = text.OPENERS.index(state)
        if r.ended[n] or not state:
            owner = r.block
        state = bytes(r.ends[n])
    return out


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, record, part, kind, table, raw`` of every statement, in no order; the first four give the place."""
    records = (
        spark.read.option("lineSep", ";\n").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("record"), F.col("value").cast("binary").alias("value"),
                (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("last"))
    )
    within = _unsettled(records)

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = None
        for (file, at), record, done, block in _in_blocks(batches, within):
            if record is None:  # the block's end
                if block.held:
                    if block.within:  # all of it is within one statement
                        yield file, within[file, at][1], at, LATER, PIECE, None, block.held[len(block.within) :]
                    elif text.open_at_end(block.held):
                        yield file, at, *(place or (0, 0)), PIECE, None, block.held
                    else:
                        yield _row((file, at, place[0]), place[1], block.held)
                continue
            for i, s in enumerate(done):
                if block.within:
                    yield file, within[file, at][1], at, LATER, PIECE, None, s[len(block.within) :]
                    block.within = b""
                else:
                    yield _row((file, at, record), i, s)
            place = (record, len(done))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((len(r[-1]), r) for r in statements(batches)), _ARROW)

    out = records.mapInArrow(whole, STATEMENT)
    if not within:
        return out
    # the first piece has the statement's place, a later one that of its block in the file
    out = written(out, "statements")
    pieces = out.where(F.col("kind") == PIECE).select("file", "block", F.struct((F.col("part") == LATER).alias("later"), "record", "part", "raw").alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_row((f, block, parts[0]["record"]), parts[0]["part"], b"".join(p["raw"] for p in parts)) for b in batches for f, block, parts in _each(b))
        yield from _batches(((len(r[-1]), r) for r in rows), _ARROW)

    gathered = pieces.groupBy("file", "block").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    return out.where(F.col("kind") != PIECE).unionByName(gathered.mapInArrow(joined, STATEMENT))


@dataclass
class Dump:
    """A dump's statements, kept in the shared folder by table, so that what is of one table reads no other's; and its definitions."""

    statements: DataFrame
    tables: dict[str, text.TableDef]
    path: str

    def close(self) -> None:
        """Deletes the statements; nothing may read them any more."""
        dropped(self.statements.sparkSession, self.path)

    def rows(self, table: str) -> DataFrame:
        """The table's rows: place of the statement, ``row``, and for each column ``lit_<n>`` as written and ``str_<n>`` if text.

        ``head`` is what the statement has before its values, on its first row.
        """
        info = self.tables[table]
        names = [c.name for c in info.columns]
        schema = ", ".join(["file string, block long, record long, part int, `row` int, head binary", *(f"lit_{n} binary, str_{n} binary" for n in range(len(names)))])
        arrow = [*_ARROW[:4], ("row", pa.int32()), ("head", pa.binary()), *((f"{k}_{n}", pa.binary()) for n in range(len(names)) for k in ("lit", "str"))]

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
            for *at, raw in (r for b in batches for r in _each(b)):
                head = text.insert_head(raw)
                order = head.columns or names
                for n, values in enumerate(text.tuples(raw, head.body)):
                    if len(values) != len(order):
                        raise text.DumpError(f"{table}: {len(values)} values for {len(order)} columns")
                    by = dict(zip(order, values, strict=True))
                    yield sum(len(x) for x, _ in values), (*at, n, None if n else head.prefix, *(x for c in names for x in by.get(c, (None, None))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(found(batches), arrow)

        some = self.statements.where((F.col("kind") == "insert") & (F.col("table") == table))
        return some.select(*PLACE, "raw").mapInArrow(run, schema)

    def table(self, name: str) -> DataFrame:
        """The table with typed columns, and what its definition says as the fields' metadata. Dates that are none are null."""
        info, rows = self.tables[name], self.rows(name)
        out = []
        for n, c in enumerate(info.columns):
            kind = text.spark_type(c.sql_type)
            plain = F.coalesce(F.col(f"str_{n}"), F.when(F.upper(F.col(f"lit_{n}").cast("string")) != "NULL", F.col(f"lit_{n}")))
            if kind == "binary":  # 0xAB... is written so
                code = plain.cast("string")
                plain = F.when(F.col(f"str_{n}").isNull() & code.rlike("^0[xX]([0-9A-Fa-f]{2})*$"), F.unhex(F.substr(code, F.lit(3)))).otherwise(plain)
            value = plain.cast("string") if kind == "string" else plain if kind == "binary" else plain.cast("string").try_cast(kind)
            out.append(value.alias(c.name, metadata={"nullable": c.nullable, "max_len": c.max_len, "unique": c.unique, "generated": c.generated, "sql_type": c.sql_type.split("(")[0]}))
        return rows.select(*out)

    def first_texts(self, name: str, limit: int = SAMPLES) -> DataFrame:
        """``table, column, sql_type, value``: the first ``limit`` non-empty strings of each of the table's columns, in order of place.

        One pass for all columns. A task keeps its first ones of each and, once all are full, reads no later statement's rows.
        """
        info = self.tables[name]
        names = [c.name for c in info.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[list[tuple]] = [[] for _ in names]
            bound: list[tuple | None] = [None] * len(names)  # places from here on are of no use to the column
            for *at, raw in (r for b in batches for r in _each(b)):
                if all(x is not None and tuple(at) > x[:4] for x in bound):
                    continue
                head = text.insert_head(raw)
                order = head.columns or names
                for n, values in enumerate(text.tuples(raw, head.body)):
                    if len(values) != len(order):
                        raise text.DumpError(f"{name}: {len(values)} values for {len(order)} columns")
                    by, place = dict(zip(order, values, strict=True)), (*at, n)
                    for i, c in enumerate(names):
                        value = by.get(c, (None, None))[1]
                        if value and (bound[i] is None or place < bound[i]):
                            kept[i].append((place, value))
                            if len(kept[i]) >= 2 * limit or bound[i] is None and len(kept[i]) == limit:
                                kept[i] = sorted(kept[i])[:limit]
                                bound[i] = kept[i][-1][0]
            found = ((len(v), (*p, i, v)) for i, some in enumerate(kept) for p, v in sorted(some)[:limit])
            yield from _batches(found, [*_ARROW[:4], ("row", pa.int32()), ("n", pa.int32()), ("value", pa.binary())])

        some = self.statements.where((F.col("kind") == "insert") & (F.col("table") == name))
        found = some.select(*PLACE, "raw").mapInArrow(run, "file string, block long, record long, part int, `row` int, n int, value binary")
        which = F.col("n") + 1
        return first_samples(
            found.select(
                F.lit(name).alias("table"), F.element_at(F.array(*map(F.lit, names)), which).alias("column"), F.element_at(F.array(*[F.lit(c.sql_type.split("(")[0]) for c in info.columns]), which).alias("sql_type"),
                F.struct(*PLACE, "row").alias("pos"), F.col("value").cast("string").alias("value"),
            ), limit,
        )

    def text_table(self, name: str, placed: bool = True) -> DataFrame:
        """The table's strings only, as for sampling: other values are null."""
        info, rows = self.tables[name], self.rows(name)
        return rows.select(*[x for x in (*PLACE, "row") if placed], *[F.col(f"str_{n}").cast("string").alias(c.name, metadata={"sql_type": c.sql_type.split("(")[0], "generated": c.generated}) for n, c in enumerate(info.columns)])

    def notable(self) -> list[str]:
        """First lines of views, triggers and procedures, which are passed on as they are."""
        some = self.statements.where(F.col("kind") == "raw").where(F.upper(F.col("raw").cast("string")).rlike("(?s)CREATE.*(VIEW|TRIGGER|PROCEDURE)"))
        return [r[0].strip().split("\n")[0] for r in some.select(F.col("raw").cast("string")).collect()]


def read_dump(spark: SparkSession, path: str) -> Dump:
    """The dump at ``path``, whose text is read once; table definitions (small) come to the driver, whatever their place. Data of a
    table without one is an error."""
    at = shared_path(spark, "statements")
    read_statements(spark, path).select("file", "block", "record", "part", "kind", "raw", "table").write.partitionBy("table").option("compression", "zstd").parquet(at)
    statements = spark.read.schema("file string, block long, record long, part int, kind string, raw binary, table string").parquet(at)
    found = [text.parse_create(bytes(r[0])) for r in statements.where(F.col("kind") == "create").orderBy(*PLACE).select("raw").collect()]
    tables = {t.name: t for t in found}
    loose = [r[0] for r in statements.where(F.col("kind") == "insert").select("table").distinct().collect() if r[0] not in tables]
    if loose:
        raise text.DumpError(f"data without a CREATE TABLE: {', '.join(sorted(loose))}")
    return Dump(statements, tables, at)


def _literal(value: F.Column) -> F.Column:
    """A text as a quoted string; the backslash first."""
    out = value
    for a, b in (("\\", "\\\\"), ("\0", "\\0"), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x1a", "\\Z"), ("'", "\\'"), ('"', '\\"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("'"), out, F.lit("'")).cast("binary")


def anonymize_dump(dump: Dump, config: Config, key: bytes | None = None) -> DataFrame:
    """``file, block, record, part, raw``: the statements with the config's rules applied to their rows.

    Values no rule changes stay as they are written, byte for byte. Presets only read strings; numbers and binaries are kept.
    Statements of skipped tables go, their definitions stay. All definitions are checked before any row is read.
    """
    key = resolve_key(config) if key is None else key
    plans = {t: plan_table(t, d.columns, config) for t, d in dump.tables.items()}
    out = dump.statements.where(F.col("kind") != "insert").select(*PLACE, "raw")
    for t, d in dump.tables.items():
        plan = plans[t]
        if plan.skipped:
            continue
        insert = dump.statements.where((F.col("kind") == "insert") & (F.col("table") == t))
        if all(r == KEEP for r in plan.rules.values()):
            out = out.unionByName(insert.select(*PLACE, "raw"))
            continue
        rows = dump.rows(t)
        own = {c: f"_dump_{c}" for c in rows.columns}  # a column of the table may be named like one of ours
        texts = rows.select(*[F.col(c).alias(n) for c, n in own.items()], *[F.col(f"str_{n}").cast("string").alias(c.name) for n, c in enumerate(d.columns)])
        made = transform(texts, plan, key)
        values = []
        for n, c in enumerate(d.columns):
            lit, rule = F.col(own[f"lit_{n}"]), plan.rules[c.name]
            is_null = F.upper(lit.cast("string")) == "NULL"
            null = F.lit("NULL").cast("binary")
            if rule.kind == "keep":
                value = lit
            elif rule.kind == "null" and c.nullable:
                value = null
            elif rule.kind in ("null", "constant"):
                value = F.when(is_null, null).otherwise(_literal(F.lit(rule.value)))
            else:
                value = F.when(F.col(own[f"str_{n}"]).isNull(), lit).otherwise(_literal(F.col(f"`{c.name}`")))
            values.append(F.when(lit.isNotNull(), value))
        # columns that the INSERT leaves out have no literal; explicit lists keep their own order
        parts = F.filter(F.array(*[F.struct(F.lit(c.name).alias("name"), v.alias("v")) for c, v in zip(d.columns, values, strict=True)]), lambda x: x["v"].isNotNull())
        packed = made.select(*[F.col(own[c]).alias(c) for c in (*PLACE, "row", "head")], parts.alias("values"))
        gathered = packed.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("row", "head", "values"))).alias("rows"))

        def rebuilt(batches: Iterator[pa.RecordBatch], names=tuple(c.name for c in d.columns)) -> Iterator[pa.RecordBatch]:
            def statements() -> Iterator[tuple]:
                for *at, rows_ in (r for b in batches for r in _each(b)):
                    head = text.insert_head(rows_[0]["head"])
                    lines = []
                    for r in rows_:
                        by = {x["name"]: x["v"] for x in r["values"]}
                        lines.append(b"(" + b",".join(by[c] for c in head.columns or names) + b")")
                    yield *at, head.prefix + b",".join(lines) + b";\n"

            yield from _batches(((len(r[-1]), r) for r in statements()), [*_ARROW[:4], _ARROW[-1]])

        out = out.unionByName(gathered.mapInArrow(rebuilt, "file string, block long, record long, part int, raw binary"))
    return out


def write_dump(statements: DataFrame, path: str) -> None:
    """Statements in order of place as text files, to be read in order of name; Spark commits them all or none."""
    ordered = statements.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    ordered.select(F.regexp_replace(F.col("raw").cast("string"), r"\n\z", "").alias("value")).write.option("lineSep", "\n").text(path)


def dump_bytes(statements: DataFrame) -> Iterator[bytes]:
    """The dump in order, a partition at a time, for a pipe."""
    for r in statements.orderBy(*PLACE).select("raw").toLocalIterator():
        yield bytes(r[0])


def spooled(spark: SparkSession, stream, chunk: int = 1 << 22) -> str:
    """Puts a stream, such as standard input, into a file of the shared folder, a piece at a time; returns the path."""
    path = shared_path(spark, "input")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        while piece := stream.read(chunk):
            out.write(bytearray(piece))
    finally:
        out.close()
    return path
