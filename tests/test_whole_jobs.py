import json
import random
import re
from datetime import datetime, timedelta

from folioscope.functions.html import from_markdown, to_markdown
from folioscope.operators import catalog
from folioscope.plans import catalogs, retrieval, texts
from folioscope.streaming import pages as streaming

STORED = "page_no bigint, url string, title string, markdown string"
LISTED = "manifest_no int, source_id string, url string, content_hash string, crawled_at timestamp, loaded_at timestamp"
CRAWLS = "manifest_no int, source_id string, version string, snapshot_seq int"
T = datetime(2025, 1, 1)


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")


def test_whole_pages_are_parsed(spark, tmp_path):
    page = (
        "# Über `a_b`\r\n\r\n" + " ".join(f"слово{i}" for i in range(40)) + "\r\n\r\n- one **two**\r\n- three\r\n  - [inner](https://o/x)\r\n\r\n4. four\r\n\r\n"
        "~~~py\r\nif a < b:\r\n\r\n    # no heading\r\n~~~\r\n\r\n| k | v |\r\n| --- | --- |\r\n| a & b | 日本 |\r\n\r\n> quoted\r\n\r\n***\r\n\r\n2 < 3 </main> *end*"
    )
    stored(spark, tmp_path, "stored_pages", [(1, "https://h/a", "T", page), (1, "https://h/a", "T", page), (2, "https://h/b", None, None)], STORED)
    got = {r.page_no: r for r in catalogs.queries()["parsed_pages"](spark, str(tmp_path)).collect()}
    words = " ".join(f"слово{i}" for i in range(40))
    assert got[1].markdown == (
        f"## Page\n\n# Über `a_b`\n\n{words}\n\n- one **two**\n- three\n  - [inner](https://o/x)\n\n4. four\n\n```py\nif a < b:\n\n    # no heading\n```\n\n"
        "| k | v |\n| --- | --- |\n| a & b | 日本 |\n\n> quoted\n\n---\n\n2 < 3 </main> *end*\n\nEnd of **page**"
    )
    assert got[1].links == ["https://h/a#top", "https://h/root?q=1", "https://o/x"]
    assert got[2].markdown == "## Page\n\nEnd of **page**" and not got[2].missing


def test_no_word_is_lost_in_html():
    words = lambda text: re.findall(r"[^\W_]+", re.sub(r"(?m)^([>\s]*(?:- )*)\d+[.)] ", r"\1", text))
    starts = ["", "", "", "# ", "#### ", "- ", "* ", "  - ", "> ", "> > ", "| ", "\t", "    ", "***", "---"]
    for seed in range(2000):
        r = random.Random(seed)
        line = lambda: r.choice(starts) + " ".join(r.choice(["aé", "**b**", "`c<d`", "*e", "&amp;", "<p>", "语", "x_y", "|"]) for _ in range(r.randint(0, 4)))  # noqa: E731, B023
        text = "\n".join(line() for _ in range(r.randint(0, 12)))
        assert words(to_markdown("https://h/", from_markdown(text))) == words(text), text


def test_all_crawls_are_merged(spark, tmp_path):
    r = random.Random(5)
    crawls = [(10 * s + n, "s", v, n) for s, v in enumerate((None, "v1")) for n in range(1, 10)]
    rows = [(m, "s", f"https://h/p{r.randint(1, 12)}", r.choice([f"{m:x}a", None]), T + timedelta(hours=i), T) for i, (m, *_) in enumerate(crawls) for _ in range(5)]
    rows += [(3, "s", "HTTPS://H:443/p99#x", "SHA256:AA", T, T), (3, "s", "https://h/p99", "bb", T - timedelta(days=1), T), (3, "s", None, "cc", T, T)]
    stored(spark, tmp_path, "page_snapshots", rows, LISTED)
    stored(spark, tmp_path, "manifests", crawls, CRAWLS)
    left = {}
    for number, _, version, seq in sorted(crawls, key=lambda x: x[3]):
        for m, _, url, digest, *_ in sorted((x for x in rows if x[0] == number and x[2] and "p99" not in x[2]), key=lambda x: x[3] or ""):
            left[version, url] = (seq, digest)
    left[None, "https://h/p99"] = (3, "aa")
    got = catalogs.queries()["merged_series"](spark, str(tmp_path)).collect()
    assert {(x.version, x.url): (x.snapshot_seq, x.content_hash) for x in got} == left and len(got) == len(left)
    assert max(seq for seq, _ in left.values()) == 9


def test_fold_equals_merging_one_after_another(spark):
    r = random.Random(6)
    rows = [(n, f"u{u}", r.choice([None, f"{n}-{u}"])) for n in range(1, 5) for u in r.sample(range(9), 4)]
    df = spark.createDataFrame(rows, "n int, url string, content_hash string")
    merged = df.where("n = 1").drop("n")
    for n in range(2, 5):
        merged = catalog.merge_documents(merged, df.where(f"n = {n}").drop("n"))
    folded = catalog.fold_documents(df, ["url"], ["n"], ["content_hash"])
    assert sorted(map(str, folded.collect())) == sorted(map(str, merged.collect()))


def plain_chunks(text, limit=800, overlap=100):
    """The chunk rules as a plain walk over lines and blocks, for ASCII and ideographic white space."""
    size = lambda t: max(1, (len(t) + 3) // 4)
    found, own, path, fenced = [], [], [], False

    def end():
        if "\n".join(own).strip():
            found.append(("\n".join(own).strip(), list(path)))
        own.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        fence = line.strip().startswith(("```", "~~~"))
        heading = re.match(r"(#{1,6})\s+(\S.*)$", line)
        if heading and not fenced and not fence:
            end()
            level = len(heading[1])
            path = (path + [""] * 6)[: level - 1] + [heading[2].strip()]
        elif not line.strip() and not fenced:
            end()
            continue
        own.append(line)
        fenced ^= fence
    end()
    parts = []
    for block, at in found:
        if size(block) <= limit or block.startswith(("```", "~~~")):
            parts.append((block, at))
            continue
        piece = ""
        for word in block.split():
            if piece and size(f"{piece} {word}") > limit:
                parts.append((piece, at))
                piece = ""
            piece = f"{piece} {word}".strip()
        parts.append((piece, at))
    chunks, current = [], []
    for part in parts:
        if current and sum(size(t) for t, _ in current) + size(part[0]) > limit:
            chunks.append(current)
            kept = []
            while len(kept) < len(current) and sum(size(t) for t, _ in kept) < overlap:
                kept = current[len(current) - len(kept) - 1 :]
            current = kept
        current = [*current, part]
        if size(part[0]) > limit:
            chunks.append(current)
            current = []
    chunks += [current] if current else []
    return [(n, chunk[-1][1], "\n\n".join(t for t, _ in chunk) + "\n") for n, chunk in enumerate(chunks)]


def test_all_documents_are_chunked(spark, tmp_path):
    r = random.Random(7)
    word = lambda: r.choice(["слово", "語彙文字列", "word", "Ünï", "x" * 30])
    block = lambda: r.choice(["# {}", "## {}\n{}", "{}", "{}\r\n{}", "```\n{}\n\n{}\n```", "### {}\n\n- {}"]).replace("{}", " ".join(word() for _ in range(r.choice([3, 40, 900]))))
    docs = [(i, "\n\n".join(block() for _ in range(r.randint(1, 14)))) for i in range(40)]
    docs += [(90, None), (91, " \n"), (92, "ПРОПИСНЫЕ"), (93, "short line"), (94, "語" * 5000), (95, "```\n" + "line\n\n" * 900)]
    stored(spark, tmp_path, "documents", docs, "doc_id bigint, text string")
    got = texts.queries()["document_chunks"](spark, str(tmp_path)).collect()
    want = {(d, n, " > ".join(path), chunk) for d, text in docs if text for n, path, chunk in plain_chunks(text)}
    assert {(x.doc_id, x.chunk_index, x.headings, x.markdown) for x in got} == want and len(got) == len(want)
    assert {x.doc_id for x in got} == {d for d, _ in docs} - {90, 91}


def test_json_holds_whole_result_lists(spark, tmp_path):
    named = "query_no bigint, rank_no int, point_no bigint, vector_score double, dense_score double, sparse_score double, fusion_score double, reranker_score double"
    rows = [(q, n, 100 * q + n, 0.1 * n, 0.2, 1e-7, 0.0, None if n == 4 else 1.5, "s", None if n == 2 else "v1", f"https://h/{n}", None if n == 3 else 'a "t"', None if n == 5 else ["h", "日本"], f"<b>\n{n}") for q in (1, 2) for n in range(1, 7)]
    stored(spark, tmp_path, "search_results", [*rows, *rows[:3]], f"{named}, source_id string, version string, url string, title string, heading_path array<string>, markdown string")
    shown = retrieval.results(spark, str(tmp_path)).withColumnRenamed("rank_no", "rank")
    got = {x.query_no: json.loads(x.json) for x in retrieval.s.result_json(shown.select("query_no", "rank", "point_no", *retrieval.s.RESULT_COLUMNS), "query_no").collect()}
    names = ["rank", "point_no", *retrieval.s.RESULT_COLUMNS]
    assert got == {q: {"results": [{k: v for k, v in zip(names, x[1:]) if v is not None} for x in rows if x[0] == q]} for q in (1, 2)}
    back = retrieval.queries()["result_json"](spark, str(tmp_path)).collect()
    assert {(x.query_no, x.rank, x.markdown, x.reranker_score) for x in back} == {(x[0], x[1], x[13], x[7]) for x in rows} and len(back) == len(rows)


def test_late_and_repeated_pages_of_a_stream(spark, tmp_path):
    page = lambda name, days, text, version="1": ("s", version, f"https://h/{name}", f"<title>t</title><main><p>{text}</main>", T + timedelta(days=days))
    triggers = [
        [page("a", 30, "a first"), page("a", 30.5, "a second"), page("b", 30, "b first"), page("null", 30, "n first", None)],
        [page("late", 0, "late page"), page("b", 29, "b before"), page("a", 30.5, "a second"), ("s", "1", "https://h/a", "<div>no content</div>", T + timedelta(days=60))],
        [page("b", 31, ""), page("null", 40, "n second", None), page("late#x", 1, "late again"), page("late", 0.5, "late between")],
    ]
    got = []
    check = f"{tmp_path}/check"
    for n, rows in enumerate(triggers):
        spark.createDataFrame(rows, streaming.PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        source = streaming.read_pages(spark, f"{tmp_path}/in/*", 1)
        streaming.write_chunks(source, ["main"], lambda df, _: got.append(df.select("source", "version", "url", "crawled_at", "chunk_index", "markdown").collect()), check).awaitTermination()
    told = [sorted((x.url[10:], x.markdown.strip()) for x in batch) for batch in got]
    assert told == [[("a", "a second"), ("b", "b first"), ("null", "n first")], [("late", "late page")], [("late", "late again"), ("null", "n second")]]
    chunks = spark.createDataFrame([x for batch in got for x in batch], "source string, version string, url string, crawled_at timestamp, chunk_index int, markdown string")
    left = streaming.current_chunks(chunks, streaming.written_pages(spark, check)).collect()
    assert sorted((x.url[10:], x.markdown.strip()) for x in left) == [("a", "a second"), ("late", "late again"), ("null", "n second")]
    assert streaming.written_pages(spark, check, 1).count() == 3


def test_no_half_of_the_points_is_left_out_of_the_cache(spark, tmp_path):
    rows = [(2, "twice even", 1), (4, "twice even", 0), (1, "twice odd", 0), (3, "twice odd", 1), (5, "three", 0), (6, "three", 1), (7, "three", 2), (8, "no vector", None), (9, "no vector", None), (10, "once", 3), (11, "late vector", None), (12, "late vector", 2)]
    points = [(n, f"p{n:02}", h, T + timedelta(days=d or 0), None if d is None else [float(n)]) for n, h, d in rows]
    stored(spark, tmp_path, "chunks", [*points, points[0]], "point_no bigint, point_id string, input_hash string, crawled_at timestamp, dense_vector array<float>")
    known = retrieval.queries()
    assert tuple(known["embedding_cache"](spark, str(tmp_path)).first()) == (5, 1)
    assert {x.input_hash for x in known["cached_inputs"](spark, str(tmp_path)).collect()} == {"twice even", "twice odd", "three", "late vector"}
