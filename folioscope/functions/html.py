"""HTML pages: media type, charset, title, links, content root, Markdown, redirects by meta refresh."""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.functions.batches import small_batches

# Element kinds of HTML, and the leading bytes by which a body without a useful type is judged.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li"}
ITEM_OF = {"li": ("ul", "ol"), "td": ("tr",), "th": ("tr",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
SIBLINGS = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
HTML_TYPES = ("text/html", "application/xhtml+xml")
SNIFFED_BYTES = 512
HTML_MARKS = re.compile(rb"\s*<(!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p|!--)(?=[ >])|\s*<!--", re.I)
MAGIC = ((b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b\x08", "application/x-gzip"))
BINARY = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
MEDIA_TYPE = re.compile(r"[\w!#$&^.+-]+/[\w!#$&^.+-]+\s*(;.*)?$")


def media_type(declared: str | None, body: bytes) -> str:
    """The declared type; sniffed from the first 512 bytes if it is missing, malformed or the generic binary one."""
    kind = (declared or "").strip()
    name = kind.partition(";")[0].strip().lower()
    if MEDIA_TYPE.match(kind) and name != "application/octet-stream":
        return name
    head = body[:SNIFFED_BYTES]
    if HTML_MARKS.match(head):
        return "text/html"
    if head.lstrip().startswith(b"<?xml"):
        return "text/xml"
    for mark, found in MAGIC:
        if head.startswith(mark):
            return found
    return "application/octet-stream" if BINARY.search(head) else "text/plain"


def is_html(kind: str) -> bool:
    return kind in HTML_TYPES


def decode(body: bytes, declared: str | None) -> str:
    """Charset by byte order mark, header, meta element, else UTF-8; bytes that don't fit are replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", declared or "", re.I)
    inner = re.search(rb"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
    name = named[1] if named else inner[1].decode() if inner else "utf-8"
    try:
        return body.decode(codecs.lookup(name).name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)


class TreeBuilder(HTMLParser):
    """A tolerant tree: unclosed paragraphs and list items end where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def _close(self, tags: tuple[str, ...] | frozenset[str], within: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), ("table", "button", "td", "th"))
        if tag in ITEM_OF:
            self._close(SIBLINGS.get(tag, (tag,)), ITEM_OF[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


SIMPLE = re.compile(r"([\w-]+|\*)?((?:[#.](?:\\.|[\w-])+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\]\s]+))?\])*)$")
PART = re.compile(r"#((?:\\.|[\w-])+)|\.((?:\\.|[\w-])+)|\[([\w-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\]\s]+))?\]")


def parse_selector(selector: str) -> list[list[tuple[str, str, list]]]:
    """Alternatives, each a list of (combinator, tag, conditions).

    Supported: tag, ``#id``, ``.class`` (with escapes), ``[attr]``, ``[attr=value]``, descendant and child combinators
    and commas; anything else is a ValueError.
    """
    found = []
    for alternative in selector.split(","):
        steps, combinator = [], " "
        for word in re.sub(r"\s*>\s*", " > ", alternative).split():
            if word == ">":
                combinator = ">"
                continue
            match = SIMPLE.match(word)
            if not match or not (match[1] or match[2]):
                raise ValueError(f"unsupported selector {selector!r}")
            plain = lambda x: re.sub(r"\\(.)", r"\1", x)
            tests = [("id", plain(a)) if a else ("class", plain(b)) if b else (c, d.strip("\"'") if d else None) for a, b, c, d in PART.findall(match[2])]
            steps.append((combinator, "" if match[1] in (None, "*") else match[1].lower(), tests))
            combinator = " "
        if not steps or combinator == ">":
            raise ValueError(f"unsupported selector {selector!r}")
        found.append(steps)
    return found


def _meets(node: Node, tag: str, tests: list) -> bool:
    if tag and node.tag != tag or not node.tag:
        return False
    for name, value in tests:
        own = node.attrs.get(name)
        if own is None or (name == "class" and value is not None and value not in own.split()) or (name != "class" and value is not None and own != value):
            return False
    return True


def _reaches(node: Node | None, steps: list) -> bool:
    if node is None or not _meets(node, steps[-1][1], steps[-1][2]):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    if steps[-1][0] == ">":
        return _reaches(above, steps[:-1])
    while above is not None:
        if _reaches(above, steps[:-1]):
            return True
        above = above.parent
    return False


def select_first(root: Node, selector: str) -> Node | None:
    """The first element in document order that the selector takes."""
    alternatives = parse_selector(selector)
    return next((n for n in root.walk() if any(_reaches(n, steps) for steps in alternatives)), None)


def squeezed(text: str) -> str:
    return re.sub(r"[ \t\n\r\f]+", " ", text)


class MarkdownWriter:
    """A small CommonMark writer: headings, paragraphs, emphasis, code, links, images, lists, quotes, fences, tables."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, node: Node | str) -> str:
        if isinstance(node, str):
            return re.sub(r"([\\`*_\[\]])", r"\\\1", squeezed(node))
        if node.tag in HIDDEN:
            return ""
        if node.tag == "br":
            return "  \n"
        if node.tag in ("code", "kbd", "samp"):
            return f"`{squeezed(node.text()).strip()}`" if node.text().strip() else ""
        inner = "".join(map(self.inline, node.children))
        if node.tag == "img":
            return f"![{node.attrs.get('alt', '')}]({urljoin(self.base, node.attrs.get('src', ''))})" if node.attrs.get("src") else ""
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}.get(node.tag)
        bare = inner.strip()
        if mark and bare:
            return inner[: len(inner) - len(inner.lstrip())] + f"{mark}{bare}{mark}" + inner[len(inner.rstrip()) :]
        if node.tag == "a" and node.attrs.get("href") and bare:
            return f"[{bare}]({urljoin(self.base, node.attrs['href'].strip())})"
        return inner

    def blocks(self, node: Node) -> list[str]:
        found, run = [], []

        def end_run() -> None:
            text = "\n".join(line.strip() if i else line.lstrip() for i, line in enumerate("".join(run).split("\n"))).strip()
            if text:
                found.append(text)
            run.clear()

        for child in node.children:
            if isinstance(child, str) or (child.tag not in BLOCKS and not any(isinstance(n, Node) and n.tag in BLOCKS for n in child.walk())):
                run.append(self.inline(child))
            elif child.tag not in HIDDEN:
                end_run()
                found += self.block(child)
        end_run()
        return found

    def block(self, node: Node) -> list[str]:
        if re.fullmatch("h[1-6]", node.tag):
            text = squeezed(" ".join(self.blocks(node))).strip()
            return [f"{'#' * int(node.tag[1])} {text}"] if text else []
        if node.tag == "hr":
            return ["---"]
        if node.tag == "pre":
            language = next((m[1] for n in node.walk() if (m := re.search(r"\blang(?:uage)?-([\w+#-]+)", n.attrs.get("class", "")))), "")
            body = node.text().strip("\n")
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
            return [f"{fence}{language}\n{body}\n{fence}"]
        if node.tag == "blockquote":
            return ["\n".join(f"> {line}".rstrip() for line in "\n\n".join(self.blocks(node)).split("\n"))] if node.text().strip() else []
        if node.tag in ("ul", "ol"):
            return self.list_items(node)
        if node.tag == "table":
            return self.table(node)
        return self.blocks(node)

    def list_items(self, node: Node) -> list[str]:
        lines, number = [], int(node.attrs.get("start", "1") if node.attrs.get("start", "1").isdigit() else 1)
        for item in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            body = "\n".join(self.blocks(item)) or ""
            lines.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        return ["\n".join(lines)] if lines else []

    def table(self, node: Node) -> list[str]:
        rows = [
            [squeezed(" ".join(self.blocks(c))).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
            for r in node.walk() if r.tag == "tr"
        ]
        rows = [r for r in rows if r]
        if not rows:
            return []
        width = max(map(len, rows))
        line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
        return ["\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])]


def to_markdown(page_url: str, fragment: Node | str) -> str:
    node = tree(fragment) if isinstance(fragment, str) else fragment
    wrapped = node if not node.tag else Node("", {}, None, [node])
    return "\n\n".join(MarkdownWriter(page_url).blocks(wrapped)).strip()


def meta_refresh(root: Node) -> str | None:
    """Target of the first refresh element if its delay is exactly 0 and its quotes are balanced."""
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get("http-equiv", "").strip().lower() == "refresh":
            match = re.fullmatch(r"\s*0(?:\.0*)?\s*[;,]\s*url\s*=\s*(.*?)\s*", node.attrs.get("content", ""), re.I | re.S)
            if not match:
                return None
            target = match[1]
            if target[:1] in "\"'" and target[:1]:
                if len(target) < 2 or target[-1] != target[0]:
                    return None
                target = target[1:-1].strip()
            return target or None
    return None


def parse_page(url: str, page: str, selectors: list[str]) -> dict:
    """title, links (absolute, distinct, sorted), markdown, missing, refresh of a page.

    Links come from the whole page, also where no selector finds the content (``missing``).
    """
    root = tree(page)
    title = next((n.text().strip() for n in root.walk() if n.tag == "title"), "")
    links = set()
    for node in root.walk():
        href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
        if "href" in node.attrs and node.tag == "a":
            try:
                links.add(urljoin(url, href))
            except ValueError:
                continue
    content = next((n for s in selectors if s and s.strip() and (n := select_first(root, s)) is not None), None)
    return {
        "title": title, "links": sorted(links), "missing": content is None, "refresh": meta_refresh(root),
        "markdown": None if content is None else to_markdown(url, content),
    }


PAGE = pa.struct([
    ("title", pa.string()), ("links", pa.list_(pa.string())), ("markdown", pa.string()), ("missing", pa.bool_()), ("refresh", pa.string()),
])


def parse_pages(pages: DataFrame, keys: list[str], url: str, page: str, selectors: list[str]) -> DataFrame:
    """The keys with the parsed page's columns title, links, markdown, missing, refresh; a null page counts as empty."""
    for selector in selectors:
        parse_selector(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_page"):
            urls, texts = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("_url", "_page"))
            parsed = [parse_page(u or "", p or "", selectors) for u, p in zip(urls, texts)]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("_url", "_page")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(parsed, PAGE)], [*keys, "_p"])

    picked = pages.select(*(pages[k] for k in keys), pages[url].alias("_url"), pages[page].alias("_page"))
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    kind = "struct<title:string,links:array<string>,markdown:string,missing:boolean,refresh:string>"
    return picked.mapInArrow(run, f"{schema}, _p {kind}").select(*keys, "_p.*")


def escape(text: str) -> str:
    return html.escape(text)


# Line kinds of Markdown, and the marks within a line.
FENCE_LINE = re.compile(r"\s*(```+|~~~+)\s*([\w+#-]*)")
HEADING_LINE = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*$")
RULE_LINE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*$")
ITEM_LINE = re.compile(r"(\s*)(?:([-*+])|(\d{1,9})[.)])[ \t]+(?=\S)")
TABLE_RULE = re.compile(r"\s*\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$")
INLINE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)|(!?)\[([^\[\]]*)\]\(([^()\s]+)\)|\*\*(?=\S)(.+?)(?<=\S)\*\*|\*(?=[^\s*])([^*]+?)(?<=\S)\*", re.S)


def inline_html(text: str) -> str:
    """Code, images, links, strong and emphasized text as elements; all else is escaped text."""
    parts, at = [], 0
    for m in INLINE.finditer(text):
        parts.append(escape(text[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(f"<code>{escape(m[2])}</code>")
        elif m[5]:
            parts.append(f'<img src="{escape(m[5])}" alt="{escape(m[4])}">' if m[3] else f'<a href="{escape(m[5])}">{inline_html(m[4])}</a>')
        else:
            mark = "strong" if m[6] else "em"
            parts.append(f"<{mark}>{inline_html(m[6] or m[7])}</{mark}>")
    return "".join([*parts, escape(text[at:])])


def _starts_block(line: str) -> bool:
    return bool(not line.strip() or FENCE_LINE.match(line) or HEADING_LINE.match(line) or RULE_LINE.match(line) or ITEM_LINE.match(line) or line.lstrip()[:1] in (">", "|"))


def from_markdown(markdown: str) -> str:
    """HTML of a whole Markdown text, block by block: headings, fences, lists, quotes, tables, rules, paragraphs.

    No text is left out: what is none of these is an escaped paragraph. A fence that is not closed runs to the end.
    """
    return _blocks_html(markdown.replace("\r\n", "\n").split("\n"))


def _blocks_html(lines: list[str]) -> str:
    out, at = [], 0
    while at < len(lines):
        line, low = lines[at], at
        at += 1
        if not line.strip():
            continue
        if fence := FENCE_LINE.match(line):
            while at < len(lines) and not FENCE_LINE.match(lines[at]):
                at += 1
            kind = f' class="language-{escape(fence[2])}"' if fence[2] else ""
            rest = line[fence.end() :].strip()
            body = "\n".join([*([rest] if rest else []), *lines[low + 1 : at]])
            out.append(f"<pre><code{kind}>{escape(body)}</code></pre>")
            after = FENCE_LINE.sub("", lines[at]).strip() if at < len(lines) else ""
            name = FENCE_LINE.match(lines[at])[2] if at < len(lines) else ""
            at += 1
            if name or after:
                out.append(f"<p>{inline_html(f'{name} {after}'.strip())}</p>")
        elif heading := HEADING_LINE.match(line):
            level = len(heading[1])
            out.append(f"<h{level}>{inline_html(heading[2])}</h{level}>")
        elif RULE_LINE.match(line):
            out.append("<hr>")
        elif item := ITEM_LINE.match(line):
            kind, items = item[2] or "1", []
            while at <= len(lines) and (m := ITEM_LINE.match(lines[low])) and (m[2] or "1") == kind and not RULE_LINE.match(lines[low]):
                depth = m.end()
                while at < len(lines) and lines[at].strip() and (not _starts_block(lines[at]) or len(lines[at]) - len(lines[at].lstrip()) > len(m[1])):
                    at += 1
                own = [lines[low][depth:], *(x[len(x) - max(len(x.lstrip()), len(x) - depth) :] for x in lines[low + 1 : at])]
                items.append(_item_html(own))
                low, at = at, at + 1
                if low >= len(lines):
                    break
            at = low
            tag = "ul" if item[2] else "ol"
            start = f' start="{item[3]}"' if item[3] else ""
            out.append(f"<{tag}{start}>{''.join(f'<li>{x}</li>' for x in items)}</{tag}>")
        elif line.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            out.append(f"<blockquote>{_blocks_html([re.sub(r'^\s*> ?', '', x) for x in lines[low:at]])}</blockquote>")
        elif line.lstrip().startswith("|"):
            while at < len(lines) and lines[at].lstrip().startswith("|"):
                at += 1
            out.append(_table_html([x.strip() for x in lines[low:at]]))
        else:
            while at < len(lines) and not _starts_block(lines[at]):
                at += 1
            out.append(f"<p>{inline_html(chr(10).join(lines[low:at]))}</p>")
    return "".join(out)


def _item_html(lines: list[str]) -> str:
    """An item's own text without a paragraph, then what is nested in it."""
    end = next((i for i, x in enumerate(lines) if i and _starts_block(x)), len(lines))
    return inline_html("\n".join(lines[:end])) + _blocks_html(lines[end:])


def _table_html(lines: list[str]) -> str:
    ruled = len(lines) > 1 and TABLE_RULE.match(lines[1])
    rows = []
    for i, line in enumerate(lines):
        if i == 1 and ruled:
            continue
        cells = re.split(r"(?<!\\)\|", line.removeprefix("|").removesuffix("|"))
        tag = "th" if i == 0 and ruled else "td"
        rows.append("".join(f"<{tag}>{inline_html(x.strip().replace(chr(92) + '|', '|'))}</{tag}>" for x in cells))
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
