from maskwright.llm import licenses


def test_places_and_labels(spark):
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    edited = " ".join(words[:12] + ["quite", "so"] + words[12:30] + words[33:])
    rows = [
        (1, "The MIT License, and the Apache  license; GNU GENERAL-public License"), (2, None), (3, ""), (4, "license mit licence mit licensé"), (5, mit.upper()), (6, edited),
        (7, " ".join(words[:14])), (8, "x " * 30000 + "mit license"), (None, "mit license"), (9, "public license"), (9, "public license"),
    ]
    df = spark.createDataFrame([(t, i, "q") for i, t in rows], "text string, doc_id long, labels string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    assert got[1][:6] == (11, 3, 1, 8, "apache,gpl,mit", "apache,gpl,mit") and got[1][6] == 1
    assert got[2] == got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4] == (5, 0, None, None, "", "", 0.0)
    assert got[5][4:] == ("", "mit", 1.0)
    assert got[6][4:6] == ("", "mit") and 0.5 < got[6][6] < 1
    assert got[7][4:] == ("", "", 0.0)
    assert got[8][:6] == (30002, 1, 30000, 30000, "mit", "mit") and got[None][1] == 1 and got[9][1] == 0
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
    spot = licenses.alignments(df.where("doc_id = 6")).first()
    assert (spot.start, spot.end) == (0, len(edited.split()))


def test_rows_of_one_id_are_apart(spark):
    mit, gpl = licenses.TEMPLATES[0][1], next(t for x, t in licenses.TEMPLATES if x == "gpl")
    rows = [(1, mit), (1, "nothing here"), (None, gpl), (None, None), (2, gpl.replace("program", "tool")), (3, "wor\u212a " + mit.replace("copy", "\u212aopy"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r.doc_id or 0, r.labels, round(r.score, 3)) for r in licenses.scan(df).collect()), key=str)
    assert got[:4] == [(0, "", 0.0), (0, "gpl", 1.0), (1, "", 0.0), (1, "mit", 1.0)] and got[4][1:] == ("gpl", 1.0) and got[5][1] == "mit"


def test_words_are_verified(spark):
    """Votes alone are not enough: the beginning of a notice is no match; edits that break most k-grams leave one."""
    words = next(t for x, t in licenses.TEMPLATES if x == "apache" and t.startswith("unless")).split()
    third = " ".join([*words[:14], *(f"x{n}" for n in range(len(words) - 14))])
    edited = " ".join("odd" if n % 8 == 7 else w for n, w in enumerate(words))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(1, third), (2, edited)], "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "apache"}


def test_a_text_without_telling_words_has_no_gram():
    telling = set(licenses._telling())
    assert all(telling & set(g) for *_, g in licenses._grams())
