from datetime import datetime, timedelta

from folioscope.operators.snapshot_diff import KeptSnapshots, page_changes

PAGES = "manifest_no int, source_id string, url string, content_hash string, crawled_at timestamp, loaded_at timestamp, position int"
CRAWLS = "manifest_no int, source_id string, version string, snapshot_seq int, complete boolean, url string"
T = datetime(2025, 1, 1)


def run(spark, pages, crawls):
    rows = [(m, "s", u, h, T + timedelta(hours=t), T + timedelta(hours=t), 9) for m, u, h, t in pages]
    found = page_changes(spark.createDataFrame(rows, PAGES), spark.createDataFrame(crawls, CRAWLS))
    return sorted(tuple(r) for r in found.collect())


def test_changes(spark):
    crawls = [(1, "s", None, 1, True, ""), (2, "s", None, 2, False, ""), (3, "s", None, 3, True, ""), (4, "s", None, 4, True, ""), (9, "s", "v1", 1, True, "")]
    pages = [
        (1, "https://h/a", "aa", 0), (1, "https://h/b", "sha256:BB", 0), (1, "https://h/c", None, 0), (1, "https://h/gone", "11", 0),
        (2, "https://h/only-incomplete", "cc", 1),
        (3, "HTTPS://H:443/a#x", "AB", 2), (3, "https://h/b", "bb", 2), (3, "https://h/b", "bb", 2), (3, "https://h/c", "cc", 2), (3, "https://h/a", "aa", 1),
        (4, "https://h/a", "ab", 3), (4, "https://h/gone", "11", 3), (4, None, "x", 3), (4, "", "x", 3),
        (9, "https://h/a", "zz", 4), (77, "https://h/a", "zz", 4),
    ]
    assert run(spark, pages, crawls) == [
        (3, "https://h/a", "changed"), (3, "https://h/gone", "removed"),
        (4, "https://h/b", "removed"), (4, "https://h/c", "removed"), (4, "https://h/gone", "added"),
    ]


def test_empty_and_empty_crawl(spark):
    assert run(spark, [], []) == []
    crawls = [(1, "s", None, 1, True, ""), (2, "s", None, 2, True, ""), (3, "s", None, 3, True, "")]
    assert run(spark, [(1, "https://h/a", "aa", 0), (3, "https://h/a", "aa", 0)], crawls) == [(2, "https://h/a", "removed"), (3, "https://h/a", "added")]


def test_kept_snapshots(spark, tmp_path):
    schema = "sku string, part int, price double, name string"
    days = [
        [("a", 1, 1.0, "x"), ("b", 1, 2.0, None), ("c", 1, 3.0, "z"), ("d", 1, 4.0, "d"), (None, 1, 1.0, "n")],
        [("a", 1, 1.0, "x"), ("b", 1, 2.5, "y"), ("c", 2, 3.0, "z"), ("d", 1, 5.0, "e"), ("d", 1, 5.0, "e")],
        [("c", 2, None, "z"), ("a", 1, 1.0, "new")],
    ]
    kept = KeptSnapshots(spark, f"file://{tmp_path}/history", ["sku", "part"], ["price", "name"])
    for n, rows in enumerate(days):
        kept.keep(spark.createDataFrame(rows, schema), 10 * (n + 1))
    got = [sorted((r.sku, r.part, r.diff_kind, r.changed_columns) for r in kept.changes(n).collect()) for n in kept.numbers()]
    assert got[0] == []
    assert got[1] == [("b", 1, "changed", ["price"]), ("c", 1, "removed", []), ("c", 2, "added", []), ("d", 1, "changed", ["price", "name"])]
    assert got[2] == [("a", 1, "changed", ["name"]), ("b", 1, "removed", []), ("d", 1, "removed", [])]
    kept.keep(spark.createDataFrame([], schema), 30)
    assert {r.diff_kind for r in kept.changes(30).collect()} == {"removed"} and kept.numbers() == [10, 20, 30]
    names = kept.changes(20).inputFiles()
    assert names and not any("snapshot%3D30" in n or "snapshot=30" in n for n in names)
