import random

import pytest

from maskwright import cli
from maskwright.plans import config as cfg
from maskwright.sources import mysqldump, mysqltext

HEAD = rb"""-- dump of a shop
--

/*!40101 SET NAMES utf8mb4 */;

CREATE TABLE `account` (
  `id` int NOT NULL,
  `email` varchar(120) NOT NULL COMMENT 'generated, (once)',
  `phone` varchar(20) DEFAULT NULL,
  `about` text,
  `photo` blob,
  `total` decimal(10,2) NOT NULL,
  `seen` datetime(6) DEFAULT NULL,
  `dom` varchar(99) GENERATED ALWAYS AS (substr(`email`,1)) VIRTUAL,
  PRIMARY KEY (`id`),
  UNIQUE KEY `mail` (`email`),
  KEY `two` (`phone`,`id`),
  CONSTRAINT `fk` FOREIGN KEY (`id`) REFERENCES `other` (`id`)
) ENGINE=InnoDB;
"""
ROWS = rb"""INSERT INTO `account` (`id`, `email`, `phone`, `about`, `photo`, `total`, `seen`) VALUES (1,'a@b.fr','0612345678','it\'s; \\ ok\n',0xDEAD,-1.5e3,'2020-01-02 03:04:05.000000'),(2,'c@d.fr',NULL,'',_binary 'x''y',2.50,NULL);
INSERT INTO `account` (`id`, `email`, `phone`, `about`, `photo`, `total`, `seen`) VALUES (3,'e@f.fr','+33 6 11',NULL,NULL,3,NULL);
CREATE TABLE IF NOT EXISTS log (`id` int PRIMARY KEY);
INSERT INTO log VALUES (1),
 (2);
/*!50001 CREATE VIEW `v` AS SELECT 1 */;
-- done
"""


def load(spark, tmp_path, data, name="d.sql"):
    (tmp_path / name).write_bytes(data)
    return mysqldump.read_dump(spark, str(tmp_path / name))


def test_split():
    data = HEAD + ROWS
    done, left = mysqltext.split_statements(data)
    assert b"".join(done) + left == data and left == b""
    for n in (1, 2, 3, 7, 64):
        held, out = b"", []
        for i in range(0, len(data), n):
            some, held = mysqltext.split_statements(held + data[i : i + n])
            out += some
        assert b"".join(out) + held == data
        assert [s for s in out if mysqltext.kind_of(s)[0] == "insert"] == [s for s in done if mysqltext.kind_of(s)[0] == "insert"]
    assert mysqltext.split_statements(b"a ';\n' \"x;\n\" /* ;\n */ `;\n` -- ;\n b;\nc") == ([b"a ';\n' \"x;\n\" /* ;\n */ `;\n` -- ;\n b;\n"], b"c")


def test_definition():
    t = mysqltext.parse_create(HEAD[HEAD.index(b"CREATE") :])
    assert [(c.name, c.nullable, c.max_len, c.unique, c.generated) for c in t.columns] == [
        ("id", False, None, True, False), ("email", False, 120, True, False), ("phone", True, 20, False, False), ("about", True, None, False, False),
        ("photo", True, None, False, False), ("total", False, None, False, False), ("seen", True, None, False, False), ("dom", True, 99, False, True),
    ]
    assert len(t.foreign_keys) == 1 and mysqltext.parse_create(b"create table a.`b``c` (x int unsigned, y bigint unsigned)").name == "b`c"
    kinds = {"int": "int", "tinyint(1)": "tinyint", "bigint unsigned": "decimal(20,0)", "decimal(12,4)": "decimal(12,4)", "decimal(60,2)": "string", "datetime(6)": "timestamp_ntz", "longblob": "binary", "varbinary(16)": "binary", "enum('a')": "string", "json": "string", "year": "smallint"}
    assert {k: mysqltext.spark_type(k) for k in kinds} == kinds


def test_strings():
    rng = random.Random(42)
    for _ in range(300):
        b = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        assert mysqltext.unescape(mysqltext.escape(b)) == b
    assert mysqltext.unescape(rb"'a''b\'c\%\\'") == rb"a'b'c%\ "[:-1]


@pytest.mark.parametrize("bad", [b"INSERT IGNORE INTO `a` VALUES (1);\n", b"REPLACE INTO `a` VALUES (1);\n", b"UPDATE a SET x = 1;\n"])
def test_unknown_data_is_refused(bad):
    with pytest.raises(mysqltext.DumpError):
        mysqltext.kind_of(bad)
    with pytest.raises(mysqltext.DumpError):
        list(mysqltext.tuples(b"(1,2) ON DUPLICATE KEY UPDATE x=1;", 0))


@pytest.mark.parametrize("change", [(b"", b""), (b"ok\\n", b"semi;\nline"), (b"\n", b"\r\n")])
def test_round_trip(spark, tmp_path, change):
    data = (HEAD + ROWS).replace(*change) if change[0] else HEAD + ROWS
    dump = load(spark, tmp_path, data)
    assert b"".join(mysqldump.dump_bytes(dump.statements)) == data
    rows = sorted(dump.table("account").collect())
    assert [r.id for r in rows] == [1, 2, 3] and rows[0].photo == b"\xde\xad" and rows[1].phone is None and str(rows[0].total) == "-1500.00"
    assert dump.table("log").count() == 2 and len(dump.notable()) == 1


@pytest.mark.parametrize("seed", range(3))
def test_statements_over_blocks(spark, tmp_path, seed):
    """Strings, comments and names full of ends of lines, in many small blocks: the bytes and the rows are as they were."""
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choice(["x;\n", ";\n", "a", "\\'", "''", '"', "`", "/*", "-- ", "long word " * 9]) for _ in range(rng.randrange(12)))
    parts = ["CREATE TABLE `t` (`id` int, `row` text, `file` text);\n"]
    for n in range(60):
        if rng.random() < 0.2:
            parts.append(rng.choice(["-- note; here;\n", "/* block;\n of ' text;\n */;\n", "SET x = 1 -- y;\n + 2;\n", "\n"]))
        parts.append(f"INSERT INTO `t` VALUES ({n},'{odd()}','{odd()}');\n")
    data = "".join(parts).encode()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([64, 200, 1500])))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        dump = load(spark, tmp_path, data)
        statements = dump.statements.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert b"".join(bytes(r.raw) for r in sorted(statements, key=lambda r: (r.file, r.block, r.record, r.part))) == data
    assert sorted(r.id for r in dump.table("t").select("id").collect()) == list(range(60))
    config = cfg.parse("tables: {t: {row: hash, file: keep}}\ndefaults: {on_unclassified: keep}")
    assert b"".join(mysqldump.dump_bytes(mysqldump.anonymize_dump(dump, config, b"k" * 16))).count(b"INSERT INTO") == 60
    dump.close()


def test_anonymized(spark, tmp_path):
    dump = load(spark, tmp_path, HEAD + ROWS)
    config = cfg.parse("tables: {account: {email: email, phone: phone, about: 'constant(\"it''s\")', seen: date_shift}}\nskip_tables: [log]")
    out = b"".join(mysqldump.dump_bytes(mysqldump.anonymize_dump(dump, config, b"k" * 16)))
    assert out.startswith(HEAD) and b"INSERT INTO log" not in out and b"0xDEAD,-1.5e3" in out and b"_binary 'x''y'" in out
    assert not any(x in out for x in (b"a@b.fr", b"0612345678", b"ok")) and out.count(b"'it\\'s'") == 2
    mysqldump.write_dump(mysqldump.anonymize_dump(dump, config, b"k" * 16), str(tmp_path / "out"))
    again = mysqldump.read_dump(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in again.table("account").collect()) == [1, 2, 3]
    with pytest.raises(cfg.ConfigError):
        mysqldump.anonymize_dump(dump, cfg.parse(""))
    with pytest.raises(mysqltext.DumpError):
        load(spark, tmp_path, b"INSERT INTO `x` VALUES (1);\n", "x.sql")


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "d.sql").write_bytes(HEAD + ROWS)
    assert cli.main(["init", "--from", "d.sql", "--out", "c.yaml"]) == 0
    text = (tmp_path / "c.yaml").read_text()
    assert "email: email" in text and "phone: phone" in text
    assert cli.main(["check", "--from", "d.sql", "--config", "c.yaml"]) == 0
    assert cli.main(["transform", "--from", "d.sql", "--config", "c.yaml", "--out", "o", "--verbose"]) == 0
    assert cli.main(["transform", "--from", "d.sql", "--config", "c.yaml", "--dry-run"]) == 0
    import io
    import os
    import sys
    import threading

    os.mkfifo("pipe")
    read = []
    reader = threading.Thread(target=lambda: read.append(open("pipe", "rb").read()))
    reader.start()
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(HEAD + ROWS)}))
    assert cli.main(["transform", "--from", "-", "--config", "c.yaml", "--out", "pipe", "--progress"]) == 0
    reader.join()
    assert read[0].startswith(HEAD) and b"a@b.fr" not in read[0]
    (tmp_path / "bad.yaml").write_text("columns: {'*.phone': phone}\n")
    assert cli.main(["check", "--from", "d.sql", "--config", "bad.yaml"]) == 1
    assert cli.main(["transform", "--from", "d.sql", "--config", "bad.yaml", "--out", "p"]) == 1 and not (tmp_path / "p").exists()
    assert cli.main(["presets"]) == 0 and (tmp_path / ".maskwright" / "last-report.json").exists()
    assert "a@b.fr" not in capsys.readouterr().out
