"""One HTML page to title and markdown, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements left out with everything in them.
EXCLUDED_TAGS = ("nav", "footer", "header", "aside", "script", "style")
_BLOCKS = {"p", "div", "section", "article", "main", "blockquote", "table", "tr", "ul", "ol", "dl", "dt", "dd", "form"}
_HEADINGS = {f"h{n}": n for n in range(1, 7)}


class _Page(HTMLParser):
    def __init__(self, excluded: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.excluded = set(excluded)
        self.out: list[str] = []
        self.title: list[str] = []
        self.skipping: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[str | None] = []
        self.in_title = self.in_pre = False

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            if tag in self.excluded:
                self.skipping.append(tag)
            return
        if tag in self.excluded:
            self.skipping.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag in _HEADINGS:
            self.out.append("\n\n" + "#" * _HEADINGS[tag] + " ")
        elif tag == "pre":
            self.in_pre = True
            kind = re.search(r"language-(\w+)", dict(attrs).get("class") or "")
            self.out.append(f"\n\n```{kind.group(1) if kind else ''}\n")
        elif tag == "code" and not self.in_pre:
            self.out.append("`")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            depth = "  " * max(len(self.lists) - 1, 0)
            self.out.append(f"\n{depth}" + (f"{number}. " if number is not None else "* "))
        elif tag == "a":
            href = dict(attrs).get("href")
            self.links.append(href)
            if href is not None:
                self.out.append("[")
        elif tag == "br":
            self.out.append("\n")
        elif tag in _BLOCKS:
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if self.skipping:
            # Ends the nearest open tag of that name with all that was opened inside it; a stray end tag ends nothing.
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = False
        elif tag == "pre" and self.in_pre:
            self.in_pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.in_pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href is not None:
                self.out.append(f"]({href})")
        elif tag in _HEADINGS or tag in _BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.skipping:
            return
        if self.in_title:
            self.title.append(data)
        elif self.in_pre:
            self.out.append(data)
        else:
            self.out.append(re.sub(r"\s+", " ", data))


def page_markdown(html: str, excluded: tuple[str, ...] = EXCLUDED_TAGS) -> tuple[str, str]:
    page = _Page(excluded)
    page.feed(html)
    page.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(page.out))
    text = re.sub(r"\n[ \t]+(?![*\d ])", "\n", text) if "```" not in text else text
    return " ".join("".join(page.title).split()), re.sub(r"\n{3,}", "\n\n", text).strip()


#: Pages converted at a time; a batch of pages holds as many as Spark puts into it.
PAGES_AT_ONCE = 128


def markdown_udf(excluded: tuple[str, ...] = EXCLUDED_TAGS):
    """Arrow function from HTML to struct<title, markdown, error>; a page that fails is one NULL row."""

    def converted(pages: pa.Array) -> pa.Array:
        rows = []
        for html in pages.to_pylist():
            try:
                title, text = page_markdown(html, excluded) if html is not None else (None, None)
                rows.append((title, text, None))
            except Exception as problem:
                rows.append((None, None, str(problem)))
        titles, texts, errors = (pa.array(v, pa.string()) for v in (zip(*rows) if rows else ((), (), ())))
        return pa.StructArray.from_arrays([titles, texts, errors], ["title", "markdown", "error"])

    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for low in range(0, max(len(pages), 1), PAGES_AT_ONCE):
                yield converted(pages.slice(low, PAGES_AT_ONCE))

    # The annotation text must resolve to real types for Spark to pick the iterator form.
    convert.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Declared non-deterministic so that a filter on the markdown stays above: pushed down, it would convert every page a
    # second time, in a second Python process of the task.
    return F.arrow_udf(convert, "struct<title:string,markdown:string,error:string>").asNondeterministic()


def to_markdown(html: Column, excluded: tuple[str, ...] = EXCLUDED_TAGS) -> Column:
    return markdown_udf(excluded)(html)
