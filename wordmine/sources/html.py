"""Text of one node of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node(HTMLParser):
    def __init__(self, tag: str, attr: str, value: str):
        super().__init__(convert_charrefs=True)
        self.want, self.depth, self.parts, self.done = (tag, attr, value), 0, [], False

    def handle_starttag(self, tag, attrs):
        if self.done or tag in _VOID:
            return
        want, attr, value = self.want
        if self.depth:
            self.depth += tag == want
        elif tag == want and value in (dict(attrs).get(attr) or "").split():
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and tag == self.want[0]:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def node_text(html: str | None, tag: str, attr: str, value: str) -> str | None:
    """The text of the first ``tag`` whose ``attr`` has ``value``, with all inside it; null if there is none."""
    node = _Node(tag, attr, value)
    node.feed(html or "")
    node.close()
    return "".join(node.parts) if node.done or node.depth else None


def select_node(pages: DataFrame, tag: str = "div", attr: str = "class", value: str = "art_txt", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the selected node's text, parsed in Arrow batches."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda h: node_text(h, tag, attr, value))

    return pages.withColumn("text", text(F.col(html)))


def fetch_pages(spark, urls: list[str], timeout: float = 10.0) -> DataFrame:
    """``(url, html)`` fetched by the tasks, null for pages that fail. Needs a network."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.request import Request, urlopen

        for batch in batches:
            pages = []
            for url in batch.url:
                try:
                    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as reply:
                        pages.append(reply.read().decode("utf-8", "replace"))
                except OSError:
                    pages.append(None)
            yield batch.assign(html=pages)[["url", "html"]]

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls) // 8)).mapInPandas(run, "url string, html string")
