"""Main text of web pages by deducing each host's page template from token equivalence classes.

A page is read as tokens: elements in the role their path gives them, and short-lived text blocks. Over all pages of a host
each token gets its occurrence vector (how often it occurs on each page), kept as a count of pages and an order-free digest,
so that a host of any size is summed without gathering its pages. Tokens with one vector form an equivalence class. The class
of the vector that is one on every page is the frame of the template, without tokens that some page has in another order; elements
of a tree then nest. Tokens with other vectors are told apart by the slot of the frame they lie in and form classes again, one
level deep. Text of the frame is template text, and so is text of a nested class on ``SUPPORT`` pages and more than half of the
host's, where the class comes whole and in order. What remains are slots. Slots in roles for menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are not article text; of the others, those in an article or main element are taken, or all where
the page has none and then without lists of links; template text is left out of both. Equal pages of a host count once.

Edge cases: a null html counts as empty and gives an empty text, as does a page without article text; a null url belongs to
the host ''; a host of fewer than ``SUPPORT`` pages has no template text and is read by its roles alone; repeated rows give
repeated results; pages cut short are read as far as they go; a tag with a quote that never closes ends at its first '>'. Pages
of any length and depth are read in time that grows with their length; a path longer than ``DEEP`` is kept as its digest.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ship, table

SUPPORT = 3
PAGE = "#page"
COMMENT, MARKUP = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<[!?/][^>]*(?:>|\Z)")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Comments, tags, other markup or text; a tag that this takes for the text "<" is looked at again.
TOKEN = re.compile(rf"{COMMENT.pattern}|{TAG.pattern}|{MARKUP.pattern}|([^<]+|<)", re.S)
#: Without regard to quotes, for tags with one that is never closed.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
DEEP = 256  # characters of a path, beyond which its digest stands for it
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button", "head", "title", "canvas"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "param", "source", "track"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul dd dt li".split()
)
OTHER_ROLES = {"nav", "footer", "aside", "form", "dialog", "menu"}
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay paywall subscribe subscription newsletter signup login sidebar side widget widgets menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer bottombar copyright legal disclaimer "
    "share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion reactions "
    "search searchform tags taglist hidden skip".split()
)
#: Words around these in a name leave it the name of a part; any other makes it the name of a layout ('has-sidebar') or a subject.
PLAIN_WORDS = set("top bottom left right box block wrap wrapper container inner outer bar area section list links item items main page site module panel primary secondary global the".split())
#: Parts whose articles are not the page's.
FIRM_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion sidebar side widget widgets related "
    "recommended recommendations comment comments commentlist respond reply replies disqus".split()
)
#: Words that in an article name its own sections as well.
SECTION_WORDS = set("discussion related recommendations legal disclaimer notice notices header copyright search tags reply replies reactions side skip notification alert".split())
#: Raw elements whose end is looked for no farther than their parent's.
SOFT = {"noscript", "template", "iframe", "svg", "math", "object", "select", "button", "canvas"}
MAIN_WORDS = {"main", "article"}


def _labels(attributes: str) -> tuple[str, set[str], bool]:
    """Class and id for the role, the words in them, those of ``OTHER_WORDS`` from names of parts only, and whether the element is hidden."""
    words, names, hidden = set(), [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names.append(value)
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
                words.update(w for w in parts if w not in OTHER_WORDS or all(v in OTHER_WORDS or v in PLAIN_WORDS for v in parts))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return " ".join(names), words, hidden


class _Source:
    """A page's source with searches that remember what they found, so that looking ahead again and again costs one pass."""

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.found: dict[str, tuple[int, re.Match | None]] = {}
        self.compiled: dict[str, re.Pattern] = {}

    def pattern(self, regex: str) -> re.Pattern:
        if regex not in self.compiled:
            self.compiled[regex] = re.compile(regex, re.I)
        return self.compiled[regex]

    def search(self, regex: str, at: int) -> re.Match | None:
        """The first match from ``at`` on; ``at`` never falls from one call to the next."""
        begin, m = self.found.get(regex, (-1, None))
        if begin < 0 or (m is not None and m.start() < at):
            m = self.pattern(regex).search(self.text, at)
            self.found[regex] = at, m
        return m

    def token(self, at: int) -> tuple[int, str | None, re.Match | None]:
        """(end, text, tag) of the token at ``at``: text, a tag, or neither for comments and other markup."""
        if self.text[at] != "<":
            end = self.text.find("<", at)
            end = len(self.text) if end < 0 else end
            return end, self.text[at:end], None
        following = self.text[at + 1 : at + 2]
        if self.text.startswith("<!--", at):
            return COMMENT.match(self.text, at).end(), None, None
        named = following.isascii() and following.isalpha()
        if named or following == "/":
            if at < self.last:
                m = TAG.match(self.text, at) or PLAIN_TAG.match(self.text, at)
                if m:
                    return m.end(), None, m
            elif named:  # a tag that the page's end cuts short
                end = self.text.find("<", at + 1)
                return (len(self.text), None, None) if end < 0 else (at + 1, "<", None)
        if following in ("!", "?", "/"):
            return MARKUP.match(self.text, at).end(), None, None
        return at + 1, "<", None


def _raw_end(source: _Source, at: int, tag: str, parent: str) -> int:
    """Where a raw element that starts before ``at`` ends: after its end tag, or, unclosed, at its parent's end or the next block."""
    end = source.search(rf"</{re.escape(tag)}\b[^>]*>", at)
    if tag not in SOFT:
        return end.end() if end else len(source.text)
    depth = 0
    for m in source.pattern(rf"<(/?)({re.escape(tag)}|{re.escape(parent or tag)})\b[^>]*>").finditer(source.text, at, end.start() if end else at):
        if m[2].lower() == tag:
            break
        depth += -1 if m[1] else 1
        if depth < 0:
            break
    else:
        if end:
            return end.end()
    stop = source.search(rf"<(?:/{re.escape(parent or 'html')}|{'|'.join(sorted(CLOSES_P))})\b", at)
    return stop.start() if stop else len(source.text)


def read_page(source: str | None):
    """(blocks, elements): text blocks as (role, text, characters in links, is not article, is in main) and element roles in order."""
    blocks, elements = [], []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, role, not article, main, not article by a word that an article resets
    opened: dict[str, int] = defaultdict(int)
    text: list[str] = []
    linked, in_link = 0, 0
    page = _Source(source or "")
    at = 0

    def close(first: int) -> None:
        for x in stack[first:]:
            opened[x[0]] -= 1
        del stack[first:]

    def flush() -> None:
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            role, other, main = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", False, False)
            blocks.append((role, joined, min(linked, len(joined)), other, main, len(elements)))
        text.clear()
        linked = 0

    while at < len(page.text):
        m = TOKEN.match(page.text, at) if at < page.last else None
        if m is None or m[4] == "<":
            at, words_here, m = page.token(at)
        else:
            at, words_here = m.end(), m[4]
            m = m if m[2] else None
        if words_here is not None:
            text.append(words_here)
            linked += len(words_here) if in_link else 0
            continue
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag == "br":
                text.append(" ")
            if tag in INLINE or tag in VOID:
                continue
            flush()
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            if tag == "head" and not page.search(r"</head\b[^>]*>", at):
                end = page.search(r"<body\b", at)
                at = end.start() if end else at
                continue
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title"):
                at = _raw_end(page, at, tag, stack[-1][0] if stack else "")
            continue
        if tag == "a":
            in_link += 1
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("div", "article", "section", "td", "li", "body"):
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        names, words, hidden = _labels(m[3]) if m[3].strip() else ("", set(), False)
        above = stack[-1] if stack else ("", "", False, False, False)
        inherited = above[2] and not (above[4] and tag in MAIN_WORDS)
        main = above[3] or (tag in MAIN_WORDS and not inherited) or ("main" in words and tag == "div" and not inherited)
        other = inherited or hidden or tag in OTHER_ROLES or (tag == "header" and not above[3])
        named = words & OTHER_WORDS - (SECTION_WORDS if above[3] else set()) if tag not in ("html", "body", "article", "main") else set()
        soft = (above[4] and inherited) or (bool(named) and not named & FIRM_WORDS)
        soft = soft and not (hidden or tag in OTHER_ROLES or tag == "header" or named & FIRM_WORDS or (inherited and not above[4]))
        other = other or bool(named)
        role = f"{above[1]}/{tag}" + (f".{names}" if names else "")
        if len(role) > DEEP:
            role = "#path " + xxhash.xxh3_128_hexdigest(role.encode("utf-8", "surrogatepass"))
        opened[tag] += 1
        stack.append((tag, role, other, main, soft))
        elements.append(role)
    flush()
    return blocks, elements


def _text_token(role: str, text: str) -> str:
    return "#text " + xxhash.xxh3_128_hexdigest(f"{role}\n{text}")


def events(blocks: list, elements: list[str]) -> list[tuple[str | None, int]]:
    """(token, number of the block or -1) of elements and blocks in the page's order; blocks in other roles have no token."""
    out, b = [], 0
    for i in range(len(elements) + 1):
        while b < len(blocks) and blocks[b][5] == i:
            out.append((None if blocks[b][3] else _text_token(blocks[b][0], blocks[b][1]), b))
            b += 1
        if i < len(elements):
            out.append((elements[i], -1))
    return out


def _slots(seq: list[tuple[str | None, int]], frame: list[str]) -> list[int]:
    """The slot of each event: the place in the frame of the last frame token before it, -1 before the first."""
    order = {t: i for i, t in enumerate(frame)}
    out, last = [], -1
    for t, _ in seq:
        last = max(last, order.get(t, -1))
        out.append(last)
    return out


def page_tokens(source: str | None, frame: list[str] = (), only: list[str] | None = None) -> list[tuple[int, str, int, float]]:
    """(slot, token, occurrences, mean place) of a page, of the tokens in ``only`` where it is given."""
    seq = events(*read_page(source))
    wanted = None if only is None else set(only)
    places: dict[tuple[int, str], list[int]] = {}
    for i, ((t, _), slot) in enumerate(zip(seq, _slots(seq, frame))):
        if t is not None and (wanted is None or t in wanted):
            places.setdefault((slot, t), []).append(i)
    return [*([(-1, PAGE, 1, 0.0)] if wanted is None else []), *[(s, t, len(p), sum(p) / len(p)) for (s, t), p in places.items()]]


def out_of_order(source: str | None, frame: list[str]) -> list[str]:
    """The frame tokens outside the longest run of them that comes in the frame's order on this page."""
    order = {t: i for i, t in enumerate(frame)}
    found = [order[t] for t, _ in events(*read_page(source)) if t in order]
    ends, at, before = [], [], []  # least last place of a run of each length, where it is, and the one before
    for k, place in enumerate(found):
        i = bisect.bisect_left(ends, place)
        ends[i : i + 1], at[i : i + 1] = [place], [k]
        before.append(at[i - 1] if i else -1)
    good, k = set(), at[-1] if at else -1
    while k >= 0:
        good.add(found[k])
        k = before[k]
    return [t for i, t in enumerate(frame) if i not in good]


def article_text(source: str | None, frame: list[str], nested: list = ()) -> str:
    """The text of a page's article slots, given its host's frame in template order and the classes (slot, tokens) nested in it."""
    blocks, elements = read_page(source)
    seq = events(blocks, elements)
    slots = _slots(seq, frame)
    tokens = set(frame)
    constant = {b for t, b in seq if b >= 0 and t in tokens}
    for slot, ordered in nested:
        tokens = set(ordered)
        here = [(t, b) for (t, b), at in zip(seq, slots) if at == slot and t in tokens]
        # A class is cut where its tokens come whole and in order, once or more.
        if [t for t, _ in here] == ordered * (len(here) // len(ordered)):
            constant.update(b for _, b in here if b >= 0)
    kept = [(b, blocks[b], at) for (_, b), at in zip(seq, slots) if b >= 0 and not blocks[b][3]]
    slot_text = [(block, at) for b, block, at in kept if b not in constant]
    if any(block[4] for _, block, _ in kept):
        return "\n\n".join(block[1] for block, _ in slot_text if block[4])
    chars: dict[int, list[int]] = {}
    for block, at in slot_text:
        s = chars.setdefault(at, [0, 0])
        s[0] += len(block[1])
        s[1] += block[2]
    return "\n\n".join(block[1] for block, at in slot_text if 2 * chars[at][1] <= chars[at][0])


def _rows(df: DataFrame, schema: str, rows) -> DataFrame:
    """The tuples that ``rows`` gives for each row of ``df``."""
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def run(batches):
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in rows(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[k]) for i, k in enumerate(kinds)], names=list(names))

    return df.mapInArrow(run, schema)


def _vectors(each: DataFrame) -> DataFrame:
    """The occurrence vector of each token in each slot."""
    # A page under several addresses is no evidence of a template: what all its copies hold may be its article.
    each = each.groupBy("_host", "_slot", "_token", "_key").agg(F.first("_n").alias("_n"), F.first("_place").alias("_place"))
    return each.groupBy("_host", "_slot", "_token").agg(
        F.count(F.lit(1)).alias("_pages"), F.bit_xor(F.xxhash64("_key", "_n")).alias("_vector"), F.avg("_place").alias("_place")
    )


def _key(source: str | None) -> int:
    return xxhash.xxh3_64_intdigest((source or "").encode("utf-8", "surrogatepass")) - 2**63


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(_host, _frame, _nested): the tokens of each host's frame in template order, and the classes (slot, tokens) with text nested in it.

    ``pages`` has _host and html; equal pages count once. A frame token is on every page once and in one order. A nested class has
    one vector within one slot, ``support`` pages at least and more than half of the host's, so that text that a few articles share
    stays.
    """
    scratch, pages = Scratch(pages.sparkSession, "vectors"), pages.select("_host", "html")
    kind = "_host string, _key bigint, _slot int, _token string, _n bigint, _place double"
    vectors = _vectors(_rows(pages, kind, lambda h, s: [(h, _key(s), *t) for t in page_tokens(s)]))
    vectors = scratch.write(vectors.where((F.col("_token") == PAGE) | (F.col("_pages") >= support)))
    # A token has the frame's vector if it equals that of the page itself.
    page = vectors.where(F.col("_token") == PAGE).select("_host", F.col("_pages").alias("_all"), F.col("_vector").alias("_ones"))
    often = vectors.where(F.col("_token") != PAGE).join(page, "_host").where(2 * F.col("_pages") > F.col("_all"))
    ones = (F.col("_pages") == F.col("_all")) & (F.col("_vector") == F.col("_ones"))
    hosts = often.groupBy("_host").agg(
        F.first("_all").alias("_all"),
        F.sort_array(F.collect_list(F.when(ones, F.struct("_place", "_token")))).alias("_f"),
        F.collect_list(F.when(~ones, F.col("_token"))).alias("_rest"),
    )
    hosts = scratch.write(hosts.select("_host", "_all", F.col("_f._token").alias("_frame"), "_rest"))
    # Elements of a tree nest where they come in one order; tokens that any page has in another order leave the frame.
    bad = _rows(pages.join(hosts.select("_host", "_frame"), "_host"), "_host string, _token string", lambda h, s, f: [(h, t) for t in out_of_order(s, f)])
    bad = bad.distinct().groupBy("_host").agg(F.collect_list("_token").alias("_bad"))
    none = F.array().cast("array<string>")
    hosts = hosts.join(bad, "_host", "left").withColumn("_bad", F.coalesce("_bad", none))
    hosts = scratch.write(hosts.select("_host", "_all", F.array_except("_frame", "_bad").alias("_frame"), F.concat("_rest", "_bad").alias("_rest")))
    within = pages.join(hosts.where(F.size("_rest") > 0).select("_host", "_frame", "_rest"), "_host")
    within = _vectors(_rows(within, kind, lambda h, s, f, r: [(h, _key(s), *t) for t in page_tokens(s, f, r)]))
    within = within.join(hosts.select("_host", "_all"), "_host").where((F.col("_pages") >= support) & (2 * F.col("_pages") > F.col("_all")))
    classes = within.groupBy("_host", "_slot", "_vector").agg(F.sort_array(F.collect_list(F.struct("_place", "_token"))).alias("_c"))
    classes = classes.where(F.exists("_c", lambda t: t["_token"].startswith("#text ")))
    nested = classes.groupBy("_host").agg(F.collect_list(F.struct("_slot", F.col("_c._token").alias("_tokens"))).alias("_nested"))
    return hosts.join(nested, "_host", "left").select("_host", "_frame", "_nested")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("_row"),
        host.alias("_host"),
        F.col(html_col).alias("html"),
    )
    # The templates are written, so that the join may split a host with very many pages over tasks, or broadcast few templates.
    frames = Scratch(pages.sparkSession, "templates").write(templates(rows))
    joined = rows.join(frames, "_host", "left").select("_row", "html", "_frame", "_nested")

    def read(batches):
        for batch in batches:
            texts = [
                article_text(s, f or [], [(c["_slot"], c["_tokens"]) for c in n or []])
                for s, f, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "text"])

    kind = joined.schema["_row"].dataType.simpleString()
    done = joined.mapInArrow(read, f"_row {kind}, text string")
    return done.select("_row.page_id", "_row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
