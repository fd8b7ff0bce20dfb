"""What one task holds does not grow with its input."""

import pyarrow as pa

from maskwright.sources import mysqldump


def test_batches_end_by_bytes():
    """Long statements are handed on a few at a time, and a batch's rows are made one by one."""
    schema = [("n", pa.int64()), ("raw", pa.binary())]
    made = []

    def rows():
        for n in range(12):
            made.append(n)
            yield 1 << 20, (n, b"x" * (1 << 20))

    batches = mysqldump._batches(rows(), schema)
    first = next(batches)
    assert first.num_rows == mysqldump.BYTES >> 20 and len(made) == first.num_rows
    assert [r[0] for b in (first, *batches) for r in mysqldump._each(b)] == list(range(12))
    assert next(mysqldump._each(first))[1] == b"x" * (1 << 20)


def test_dump_samples_in_one_pass(spark, tmp_path, monkeypatch):
    """The first texts of all columns by place, each row parsed once however many columns its table has."""
    from maskwright import cli
    from maskwright.operators import classify

    row = lambda i: f"({i},{'NULL' if i % 3 else repr(f'a{i}')},'b{i}','')"
    data = "CREATE TABLE `t` (`file` int, `a` text, `b` json, `c` text);\n" + "".join(f"INSERT INTO `t` VALUES {','.join(map(row, range(n, n + 10)))};\n" for n in range(0, 300, 10))
    (tmp_path / "d.sql").write_text(data)
    monkeypatch.setattr(classify, "samples", None)  # a pass for each column
    dump = mysqldump.read_dump(spark, str(tmp_path / "d.sql"))
    got = {}
    for r in dump.first_texts("t", 30).collect():
        got.setdefault((r.table, r.column, r.sql_type), []).append(r.value)
    numbers = lambda some: sorted(int(x[1:]) for x in some)
    assert {k[1:]: numbers(v) for k, v in got.items()} == {("a", "text"): list(range(0, 90, 3)), ("b", "json"): list(range(30))}
    dump.close()
    (tmp_path / "c.yaml").write_text("defaults: {on_unclassified: keep}")
    assert cli.main(["check", "--from", str(tmp_path / "d.sql"), "--config", str(tmp_path / "c.yaml")]) == 0
