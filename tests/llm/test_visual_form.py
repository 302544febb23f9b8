import unicodedata

from folioscope.llm import visual_form as vf

SAME = [
    ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("ze​ro", "zero"), ("so­ft", "soft"), ("﻿x", "x"), ("сору", "copy"),
    ("οk", "ok"), ("non‑breaking", "non-breaking"), ("ﬁne", "fine"), ("Ａｂ１", "Ab1"), ("K", "K"), ("が", "が"), ("й", "й"),
    ("ạ́", "ạ́"), ("ԁaу", "day"), ("각", "각"), ("a\r\nb", "a\nb"), ("ｅ́", "é"), ("ϲode", "code"),
]
OTHER = [("Cafe", "cafe"), ("cafe", "café"), ("x2", "x²"), ("1", "①"), ("a b", "ab"), ("a  b", "a b"), ("word", "ward"), ("ß", "ss"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("½", "1/2")]


def test_same_and_other():
    forms = lambda pair: vf.visual_forms(list(pair))
    for pair in SAME:
        a, b = forms(pair)
        assert a == b, pair
    for pair in OTHER:
        a, b = forms(pair)
        assert a != b, pair


def test_forms_are_composed_and_stable():
    texts = [x for pair in SAME + OTHER for x in pair] + [None, "", " \t", "́ starts with a mark", "e" + "̣́̈" * 20]
    forms = vf.visual_forms(texts)
    assert vf.visual_forms(forms) == forms and forms[len(texts) - 5 : len(texts) - 3] == [None, ""]
    assert all(f is None or unicodedata.normalize("NFC", f) == f for f in forms)


def test_marks_don_t_cross_texts():
    assert vf.visual_forms(["e", "é", "́x", "é"]) == ["e", "é", "́x", "é"]


def test_pairs(spark):
    rows = [(1, "copy"), (2, "сору"), (3, "copy"), (4, None), (5, " "), (6, " "), (7, "Copy"), (8, "café"), (9, "café"), (9, "café"), (None, "cоpy")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, salts string")
    for size in (1, 2000):
        got = sorted(tuple(r) for r in vf.look_alike_pairs(df, "doc_id", "text", rows_per_salt=size).collect())
        assert got == [(1, 2), (2, 3), (8, 9)]
    forms = {r.doc_id: r.form for r in vf.with_visual_form(df.where("doc_id is not null"), "doc_id", "text").collect()}
    assert forms[2] == "copy" and forms[4] is None and forms[9] == "café"
    assert vf.look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
