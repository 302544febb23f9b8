from datetime import datetime

from folioscope.llm import repeated_lines as rl

T = datetime(2025, 1, 1)


def pages(spark):
    rows = []
    for i in range(8):
        text = f"# Page {"abcdefgh"[i]} has its own title\r\n\r\nCopyright 20{i:02} by the Makers.\nShare this page with others\n\nBody of page number {'x' * i} here\n"
        text += "Copyright 1999 by the makers!\n" if i < 2 else ""
        text += "A line on four pages only\n" if i < 4 else ""
        rows.append((i, "s", text, T, ""))
    rows += [(0, "s", rows[0][2], T, ""), (50, "t", rows[0][2], T, ""), (60, "s", None, T, ""), (61, "s", "", T, ""), (None, "s", "Copyright 2001 by the Makers.", T, "")]
    rows += [(70 + i, None, "Footer of no source at all", T, "") for i in range(5)]
    return spark.createDataFrame(rows, "page_no bigint, source_id string, markdown string, loaded_at timestamp, block string")


def test_found(spark):
    got = sorted((r.page_no, r.line_no) for r in rl.repeated_lines(pages(spark)).collect())
    assert got == sorted([(i, n) for i in range(8) for n in (3, 4)] + [(0, 7), (1, 7)] + [(70 + i, 1) for i in range(5)])


def test_blocks_join_consecutive_lines(spark):
    rows = rl.repeated_lines(pages(spark)).where("page_no < 70").collect()
    assert len({r.block for r in rows}) == 1 and len(rows) == 18


def test_clean(spark):
    got = {r.page_no: r.markdown for r in rl.without_repeated_lines(pages(spark)).collect()}
    assert got[7] == "# Page h has its own title\n\n\nBody of page number xxxxxxx here\n" and got[60] is None and got[61] == ""
    assert got[50].count("\n") == 8 and "Copyright" in got[50]


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(35, 33)], "u bigint, v bigint")
    got = {r.node: r.label for r in rl.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[35] == got[33] == 33 and got[34] == 34


def test_empty(spark):
    assert rl.repeated_lines(pages(spark).limit(0)).count() == 0


def test_matches_are_runs_of_one_block(spark):
    both, one, other = "The first boilerplate line\nThe second boilerplate line", "The first boilerplate line", "Another footer of the site"
    texts = [both] * 6 + [f"{one}\n\nA line of this page alone\nThe second boilerplate line\n{other}"] + [f"Body number {chr(97 + i) * 9}\n{other}" for i in range(6)]
    df = spark.createDataFrame([(i, "s", t, T) for i, t in enumerate(texts)], "page_no int, source_id string, markdown string, loaded_at timestamp")
    lines = rl.page_lines(df)
    blocks = rl.boilerplate_blocks(lines)
    assert {bytes(r.block) for r in blocks.collect()}.__len__() == 2 and blocks.count() == 3
    got = sorted((r.page_no, r.line_nos) for r in rl.block_occurrences(lines, blocks).collect())
    assert got == [(i, [1, 2]) for i in range(6)] + [(6, [1]), (6, [4]), (6, [5])] + [(i, [2]) for i in range(7, 13)]
