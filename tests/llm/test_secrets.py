import re

import pytest

from maskwright.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
    "github": (re.compile("gh[pousr]_[A-Za-z0-9]+"), 0, 40),
}


def brute(text):
    out = []
    for rank, (kind, (p, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


H = "0123456789abcdef" * 2
TEXTS = [
    None, "", "é日 password: token : abcdefghij", f"x{H} {H}f {H[:31]}", f"😀 api_key='{H}' APIKEY = abcdefg", "token=secret=abcdefgh1234 ToKeN: \"a.b/c+d=e-f_g\"",
    "AKIAAKIA AKIA1234567890ABCD AKIAAKIAAKIAAKIAX", "ghp_" + "a1" * 18 + " ghp_short", "password = abc secret=12345678", H + " " + H, "z " * 50_000 + H, "secret:: token=\nabcdefghijk",
]


def spans(rows):
    return sorted(((r.doc_id, [(s.start, s.rank, s.end, s.kind) for s in r.spans]) for r in rows), key=str)


@pytest.fixture
def docs(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])]
    return spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, blob string").repartition(3)


def test_against_brute_force(spark, docs):
    got, _ = secrets.scan_paths(docs)
    assert spans(got.collect()) == sorted(((i, brute(t)) for i, t in [*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3])]), key=str)
    got, _ = secrets.scan_paths(docs.limit(0))
    assert got.count() == 0


def test_ledger_scans_only_what_is_new(spark, docs):
    some = docs.where("doc_id < 6")
    _, ledger = secrets.scan_paths(some, secrets.RULES[:2])
    assert ledger.count() == 5  # null is the empty blob
    newer = (*secrets.RULES[:2], secrets.RULES[2])
    got, both = secrets.scan_paths(docs, newer, ledger)
    rows = both.collect()
    assert len(rows) == len({r.blob for r in rows}) + 5
    pairs = [(r.blob, k) for r in rows for k in r.rules]
    assert len(pairs) == len(set(pairs)) == 3 * len({r.blob for r in rows})
    whole, _ = secrets.scan_paths(docs, newer)
    assert spans(got.collect()) == spans(whole.collect())
    _, again = secrets.scan_paths(docs, newer, both)
    assert again.count() == both.count()


def test_redact(spark):
    df = spark.createDataFrame([(1, f"é token={H}!", 7), (2, None, 8), (3, "plain", 9), (3, "plain", 9)], "doc_id long, text string, blob int")
    got = sorted(map(tuple, secrets.redact(df).collect()))
    assert got == [(1, "é [assign]!", 7), (2, None, 8), (3, "plain", 9), (3, "plain", 9)]


def test_kept_ledger_and_versions(spark, tmp_path):
    """Of a second run, only new blobs and rule versions are scanned; spans are told by the version of their rule."""
    at = str(tmp_path / "ledger")
    v = lambda rows: spark.createDataFrame(rows, "doc_id long, rev int, text string")
    one = [(1, 1, f"token={H}"), (1, 2, "clean"), (2, 1, f"token={H}")]
    got, _ = secrets.scan_paths(v(one), version_col="rev", kept=at)
    assert {(r.doc_id, r.version, len(r.spans)) for r in got.collect()} == {(1, 1, 2), (1, 2, 0), (2, 1, 2)}
    assert spark.read.parquet(at).count() == 2
    got, _ = secrets.scan_paths(v([*one, (1, 3, "AKIA1234567890ABCD")]), version_col="rev", kept=at)
    assert got.count() == 4 and spark.read.parquet(at).count() == 3
    rules = tuple(secrets.Rule("hex", 2, "[0-9a-f]{64,}") if r.kind == "hex" else r for r in secrets.RULES)
    got, _ = secrets.scan_paths(v(one), rules, version_col="rev", kept=at)
    assert {(r.doc_id, r.version, tuple(s.kind for s in r.spans)) for r in got.collect()} == {(1, 1, ("assign",)), (1, 2, ()), (2, 1, ("assign",))}
    rows = spark.read.parquet(at).collect()
    pairs = [(r.blob, k) for r in rows for k in r.rules]
    assert len(pairs) == len(set(pairs)) == 3 * len(secrets.RULES) + 2
    assert [r.text for r in secrets.redact(v(one[:1]), kept=at).collect()] == ["[assign]"] and len(spark.read.parquet(at).collect()) == len(rows)


def test_many_matches(spark):
    text = "é " + " ".join([H] * 1000) + " token=abcdefgh " * 300
    got, _ = secrets.scan_paths(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert spans(got.collect()) == [(1, brute(text))]
