import pytest

from folioscope.functions import html as h


@pytest.mark.parametrize("declared, body, kind", [
    ("text/html; charset=utf-8", b"", "text/html"), ("application/xhtml+xml", b"x", "application/xhtml+xml"), ("", b"<!doctype html><p>", "text/html"),
    (None, b"plain words", "text/plain"), ("application/octet-stream", b"%PDF-1.7", "application/pdf"), ("not a type", b"<html >", "text/html"),
    ("application/json", b"<html>", "application/json"), ("application/octet-stream", b"\x00\x01", "application/octet-stream"),
])
def test_media_type(declared, body, kind):
    assert h.media_type(declared, body) == kind
    assert h.is_html(kind) == (kind in ("text/html", "application/xhtml+xml"))


def test_charset():
    assert h.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert h.decode(b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin-1") == "é"
    assert h.decode(b"<meta charset='latin-1'>\xe9", None).endswith("é")
    assert h.decode(b"\xff", "text/html; charset=nonsense") == "�"


def test_links_title_and_broken_markup():
    page = "<title> T &amp; t </title><script>'</p><a href=x>'</script><nav><a href='../b#f'>b</a></nav><article><p>one<p>two <b>bold<section><a href='/c?q'>c</a></section></article>"
    got = h.parse_page("https://h/en/a", page, ["main", "article"])
    assert got["title"] == "T & t"
    assert got["links"] == ["https://h/b#f", "https://h/c?q"]
    assert not got["missing"] and got["markdown"].startswith("one\n\ntwo")


def test_missing_content_still_has_links():
    got = h.parse_page("https://h/", "<a href=x>x</a>", ["main"])
    assert got["missing"] and got["links"] == ["https://h/x"] and got["markdown"] is None


@pytest.mark.parametrize("content, target", [
    ("0; url=/next", "/next"), ("0;URL='x y'", "x y"), ("5; url=/next", None), ("0", None), ("0; url=", None), ("0; url='x", None), ("0, url=/n", "/n"),
])
def test_meta_refresh(content, target):
    assert h.parse_page("https://h/", f'<meta http-equiv="Refresh" content="{content}">', [])["refresh"] == target


def test_selectors():
    page = '<div id=a class="x y:z"><p><span data-k=v>in</span></p></div><div class=x><p>second</p></div>'
    root = h.tree(page)
    assert h.select_first(root, "#a > p span[data-k=v]").text() == "in"
    assert h.select_first(root, r"div.y\:z").attrs["id"] == "a"
    assert h.select_first(root, "div > span") is None
    assert h.select_first(root, "main, .x p").text() == "in"
    for bad in ("p:first-child", "a + b", "", "a >"):
        with pytest.raises(ValueError):
            h.parse_selector(bad)


def test_markdown():
    page = """<h2>Head <em>line</em></h2><p>Some <strong>bold</strong>, <code>co*de</code> and a <a href="x">link</a>.</p>
<ul><li>one<li>two<ul><li>inner</li></ul></ul><ol start=3><li>three</li></ol><blockquote><p>quoted</p></blockquote>
<pre><code class="language-py">a = 1

b = 2
</code></pre><table><tr><th>k<th>v<tr><td>a|b<td>c</table><hr><img src=i.png alt=pic>"""
    assert h.to_markdown("https://h/d/", page) == (
        "## Head *line*\n\nSome **bold**, `co*de` and a [link](https://h/d/x).\n\n- one\n- two\n  - inner\n\n3. three\n\n> quoted\n\n"
        "```py\na = 1\n\nb = 2\n```\n\n| k | v |\n| --- | --- |\n| a\\|b | c |\n\n---\n\n![pic](https://h/d/i.png)"
    )


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, "https://h/a", "<title>t</title><main>x</main>", "clash"), (2, None, None, "clash")], "id int, url string, html string, title string")
    rows = {r.id: r for r in h.parse_pages(df, ["id"], "url", "html", ["main"]).collect()}
    assert rows[1].title == "t" and rows[1].markdown == "x" and rows[2].missing
