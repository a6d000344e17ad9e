"""Encyclopedia articles over HTTP as a Python data source; the fetcher can be replaced for use without a network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, FIRST_WAIT, TIMEOUT = 5, 10.0, 20.0
AGENT = "granary/1.0"


def fetch_json(url: str, params: dict, timeout: float = TIMEOUT, wait: Callable[[float], None] = time.sleep, open_url=None) -> dict | None:
    """A JSON reply, or None after all tries. Waits double when the server asks for fewer requests."""
    open_url = open_url or (lambda u: urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": AGENT}), timeout=timeout))
    for n in range(TRIES):
        try:
            with open_url(f"{url}?{urllib.parse.urlencode(params)}") as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            wait(FIRST_WAIT * 2**n if e.code == 429 else 1.0)
        except (OSError, ValueError):
            wait(1.0)
    return None


def category_titles(fetch: Callable[[dict], dict | None], category: str, limit: int) -> Iterator[str]:
    """Titles of a category's pages, page by page, at most ``limit``."""
    token, left = {}, limit
    while left > 0:
        asked = {"action": "query", "list": "categorymembers", "cmtitle": f"Category:{category}", "cmtype": "page", "cmlimit": min(100, left), "format": "json"}
        reply = fetch({**asked, **token})
        if not reply:
            return
        for member in reply.get("query", {}).get("categorymembers", [])[:left]:
            left -= 1
            yield member["title"]
        token = reply.get("continue") or {}
        if not token:
            return


def article(fetch: Callable[[dict], dict | None], title: str) -> dict | None:
    """id, title, text, url and text_length of an article; None where it has no text."""
    reply = fetch({"action": "query", "prop": "extracts", "explaintext": 1, "titles": title, "format": "json"})
    for key, page in ((reply or {}).get("query", {}).get("pages", {})).items():
        text = (page.get("extract") or "").strip()
        if key == "-1" or not text:
            return None
        name = page.get("title", title)
        url = "https://en.wikipedia.org/wiki/" + urllib.parse.quote(name.replace(" ", "_"))
        return {"id": str(key), "title": name, "text": text, "url": url, "text_length": len(text)}
    return None


class _Category(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ArticleReader(DataSourceReader):
    """One partition a category."""

    def __init__(self, options: dict):
        self.url = options.get("url", "https://en.wikipedia.org/w/api.php")
        self.categories = [c for c in options.get("categories", "").split("|") if c]
        self.limit = int(options.get("limit", 100))
        self.pause = float(options.get("pause", 1.0))

    def fetch(self, params: dict) -> dict | None:
        return fetch_json(self.url, params)

    def partitions(self) -> list[InputPartition]:
        return [_Category(c) for c in self.categories] or [_Category("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.name:
            return
        for title in category_titles(self.fetch, partition.name, self.limit):
            found = article(self.fetch, title)
            if found:
                yield found["id"], found["title"], found["text"], found["url"], found["text_length"], partition.name
            time.sleep(self.pause)


class ArticleSource(DataSource):
    """``spark.read.format('granary_articles')`` with options url, categories (joined by '|'), limit and pause."""

    @classmethod
    def name(cls) -> str:
        return "granary_articles"

    def schema(self) -> str:
        return "id string, title string, text string, url string, text_length int, source_category string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(self.options)


def stub_source(reply: Callable[[dict], dict]) -> type[DataSource]:
    """A source like ``ArticleSource`` under the name 'granary_stub_articles' whose server is a function."""

    class Reader(ArticleReader):
        def fetch(self, params: dict) -> dict | None:
            return reply(params)

    class Source(ArticleSource):
        @classmethod
        def name(cls) -> str:
            return "granary_stub_articles"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source
