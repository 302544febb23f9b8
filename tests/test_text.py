import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import ids, text
from folioscope.functions.batches import small_batches
from folioscope.functions.urls import canonical_url, in_scope


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(*columns).collect()]


def test_tokens_and_parts(spark):
    x = F.col("x")
    cases = ["HTTPServer2Go", "parseURL", "snake_case.name", "install.", "é a1", "", None]
    got = [r[0] for r in values(spark, cases, "string", text.lexical_tokens(x))]
    assert got[0] == ["httpserver2go", "http", "server2", "go"]
    assert got[1] == ["parseurl", "parse", "url"]
    assert got[2] == ["snake_case.name", "snake", "case", "name"]
    assert got[3] == ["install.", "install"]
    assert got[4] == ["é", "a1"]
    assert got[5] == [] and got[6] is None


def test_fnv_and_estimate(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    cases = ["", "a", "token", "é", "日本", "a" * 300]
    got = values(spark, cases, "string", text.fnv1a32(F.col("x")), text.token_estimate(F.col("x")))
    assert got == [(fnv(s), max(1, -(-len(s) // 4))) for s in cases]


def test_word_set_and_jaccard(spark):
    df = spark.createDataFrame([("A b cc, é cc", "cc É x"), ("", "aa"), ("aa bb", "aa bb")], "a string, b string")
    rows = df.select(text.word_set(F.col("a")), text.jaccard(text.word_set(F.col("a")), text.word_set(F.col("b")))).collect()
    assert rows[0][0] == ["cc", "é"] and rows[0][1] == 1.0
    assert rows[1][1] == 0.0 and rows[2][1] == 1.0


def test_normalized(spark):
    assert values(spark, [" A  b\n\tC "], "string", text.normalized_text(F.col("x"))) == [("a b c",)]


def test_canonical_urls(spark):
    cases = {
        "HTTP://Example.com:80/a/../b/./c//d/#frag": "http://example.com/b/c/d/", "https://h:443": "https://h/", "https://h:8443/x?Q=1#f": "https://h:8443/x?Q=1",
        "https://h/a%20b/%C3%A9": "https://h/a%20b/%C3%A9", "https://h/é": "https://h/%C3%A9", "https://h/a%2Fb": "https://h/a/b", "https://h/../..": "https://h/",
        "https://h/p/(x)": "https://h/p/%28x%29", "https://h/a%zz": "https://h/a%25zz", "notaurl#x": "notaurl", "https://h/a/..": "https://h/", None: None,
    }
    assert [r[0] for r in values(spark, list(cases), "string", canonical_url(F.col("x")))] == list(cases.values())


def test_scope(spark):
    seed = "https://docs.example.com/en/stable"
    cases = {
        "https://docs.example.com/en/stable/a": True, "https://docs.example.com/en/stable": True, "https://docs.example.com/en/stable-old/a": False,
        "https://docs.example.com/en/v2/a": False, "https://other.example.com/en/stable/a": False,
    }
    assert [r[0] for r in values(spark, list(cases), "string", in_scope(F.col("x"), F.lit(seed)))] == list(cases.values())
    assert values(spark, ["https://h/x"], "string", in_scope(F.col("x"), F.lit("https://h/"))) == [(True,)]


def test_ids(spark):
    row = spark.range(1).select(ids.sha_of(F.lit("s"), F.lit(None).cast("string"), F.lit("u")).alias("h"), ids.safe_name(F.lit("--Ab c/Dé--")).alias("n"), ids.safe_name(F.lit("!!")).alias("e"), ids.safe_path(F.lit("a/../b\\c")).alias("p")).first()
    assert row.h == hashlib.sha256(b"s\0\0u").hexdigest()
    assert (row.n, row.e, row.p) == ("ab_c_d", "source", "a___b_c")
    digest = hashlib.sha256(b"x").hexdigest()
    got = spark.range(1).select(ids.stored_point_id(F.lit(digest))).first()[0]
    assert got.replace("-", "") == digest[:32] and [len(p) for p in got.split("-")] == [8, 4, 4, 4, 12]


def test_names_and_fingerprint():
    assert ids.alias_name("My Docs", "1.0").startswith("alias_my_docs_1_0_") and len(ids.alias_name("a", None).rsplit("_", 1)[1]) == 10
    assert ids.physical_name("a", None, 5, "ff") == "a__unversioned__snapshot_5_ff"
    base = ids.profile_fingerprint("P", "https://H/v1/", "m", "document")
    assert base == ids.profile_fingerprint("p ", "HTTPS://h/v1", "m", "document", 1)
    others = {ids.profile_fingerprint(*a) for a in [("q", "https://h/v1", "m", "document"), ("p", "https://h/v2", "m", "document"), ("p", "https://h/v1", "n", "document"), ("p", "https://h/v1", "m", "query"), ("p", "https://h/v1", "m", "document", 2)]}
    assert base not in others and len(others) == 5
    assert ids.normal_endpoint(" local/ ") == "local"


def test_embedding_text(spark):
    df = spark.createDataFrame([("T", ["a", "b"], "u", "m"), (None, None, "", None)], "t string, h array<string>, u string, m string")
    got = [r[0] for r in df.select(text.embedding_text(F.col("t"), F.col("h"), F.col("u"), F.col("m"))).collect()]
    assert got == ["Title: T\nHeadings: a > b\nURL: u\nContent:\nm", "Content:\n"]


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaaa", None, "bb", "c" * 50, "", "d"])], ["n", "text"])
    got = [b.column(0).to_pylist() for b in small_batches(iter([batch, batch.slice(0, 0)]), "text", 8)]
    assert got == [[0, 1, 2], [3, 4], [5]] or got == [[0, 1, 2], [3], [4, 5]]
