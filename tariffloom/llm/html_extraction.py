"""Main text of web pages by deducing each host's page template.

Every page becomes tokens: element paths, and the texts of its blocks.  Tokens of a host that
occur equally often on the same pages (equal occurrence vectors) form an equivalence class.  A
class is valid when it holds a structural token, spans several pages that are not all copies of
one, and nests: a text of it is template where it lies under an element of its own class.  Such texts
are part of the template; what remains are the slots, and the main text is read from them, leaving
out those that the template's own names (``nav``, ``footer``, ``class="ad"``) mark as furniture.

Vectors are never spelled out: a vector is the exclusive-or of one hash per page and count, so
classes come from partial aggregates, and a host with a third of all pages is no group in a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, cut_lineage, table

PIECE = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values: element and attribute names with a meaning in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe xmp noembed noframes title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
FURNITURE = frozenset("head nav footer aside form button select option menu dialog svg math object audio video canvas input fieldset datalist".split())
CONTENT = frozenset("article main".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())

#: a class counts as template on at least so many pages
SUPPORT = 3
#: template tokens and classes (eight bytes each) that are shipped to all tasks; beyond it they are joined by host
SHIPPED = 500_000


def _furniture(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_content:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and any(p.lower() in FURNITURE_WORDS for p in NAME_PARTS.findall(value)):
            return True
    return False


def blocks(html: str) -> tuple[list[tuple[str, str, bool, bool]], Counter]:
    """Text blocks in page order as (path, text, in content, furniture), and element path counts."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, in content, furniture
    found: list[tuple[str, str, bool, bool]] = []
    paths: Counter = Counter()
    pending: list[str] = []
    at, end = 0, len(html)

    def close() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            block = next((s for s in reversed(stack) if s[0] not in INLINE), ("", "", False, False))
            found.append((block[1], text, block[2], stack[-1][3] if stack else False))

    while at < end:
        m = PIECE.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                pending.append(unescape(piece))
            elif piece.startswith("<![CDATA["):
                pending.append(piece[9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("br", "p") and not any(s[0] == tag for s in stack):
                close()
            elif any(s[0] == tag for s in stack):
                if tag not in INLINE or stack[-1][3]:
                    close()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in VOID:
            if tag == "br" or tag not in INLINE:
                pending.append(" ") if tag == "br" else close()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        block = tag not in INLINE
        if block:
            close()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and any(s[0] == "p" for s in stack)):
                stack.pop()  # a block ends an open paragraph
            if tag in CLOSES:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in CLOSES[tag]:
                        del stack[depth:]
                        break
                    if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                        break
        above = stack[-1] if stack else ("", "", False, False)
        furniture = above[3] or _furniture(tag, m[3], above[2])
        if furniture and not above[3]:
            close()
        path = f"{above[1]}/{tag}" if block else above[1]
        if len(stack) < 256:
            stack.append((tag, path, above[2] or (tag in CONTENT and not furniture), furniture))
            paths[path] += block
    close()
    return found, paths


def _key(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - (1 << 63)


def page_tokens(html: str) -> tuple[dict[int, int], set[int], int]:
    """Token -> occurrences on the page, which of them are texts, and a hash of all its texts."""
    found, paths = blocks(html)
    tokens = Counter({_key("tag", p): n for p, n in paths.items() if n})
    tokens[_key("tag", "")] = 1
    texts = Counter(_key("text", path, text) for path, text, _, furniture in found if not furniture)
    return tokens + texts, set(texts), _key("page", "", "\n".join(text for _, text, _, furniture in found if not furniture))


def nested(path: str, group: int, template: Mapping[int, int]) -> bool:
    """Is the path, or one above it, a structural token of the class?"""
    while template.get(_key("tag", path)) != group:
        if not path:
            return False
        path = path.rpartition("/")[0]
    return True


def main_text(html: str, template: Mapping[int, int] | set[int]) -> str:
    """The slots' blocks in page order; the template has the class of each of its tokens.

    Where an article or main element holds at least half of the slots' text, only its blocks are taken.
    """
    template = template or {}
    slots = []
    for path, text, content, furniture in blocks(html)[0]:
        group = None if furniture else template.get(_key("text", path, text))
        if not furniture and (group is None or not nested(path, group, template)):
            slots.append((text, content))
    inside = [text for text, content in slots if content]
    whole = 2 * sum(map(len, inside)) < sum(len(text) for text, _ in slots)
    return "\n".join([text for text, _ in slots] if whole else inside)


def host_templates(pages: DataFrame) -> DataFrame:
    """``host, tokens, classes``: the template's tokens of each host and their classes (the vectors),
    from pages with ``host, page, html``.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, html in zip(batch["host"], batch["page"], batch["html"], strict=True):
                html = html or ""
                counts, texts, content = page_tokens(html)
                rows += [(host, t, t in texts, xxhash.xxh64_intdigest(f"{page}\0{n}") - (1 << 63), content) for t, n in counts.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "is_text", "place", "content"])

    seen = pages.mapInPandas(tokens, "host string, token long, is_text boolean, place long, content long")
    vectors = seen.groupBy("host", "token").agg(
        F.max("is_text").alias("is_text"), F.bit_xor("place").alias("vector"), F.count("*").alias("pages"),
        F.min("content").alias("low"), F.max("content").alias("high")).filter(f"pages >= {SUPPORT} and low <> high")
    vectors = cut_lineage(vectors)
    classes = vectors.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens"), F.max("is_text").alias("holds"), F.max(~F.col("is_text")).alias("framed"))
    valid = classes.filter("framed and holds").select("host", "tokens", F.expr("array_repeat(vector, size(tokens))").alias("classes"))
    # both lists come from one list of structs, so that they stay in step
    return valid.groupBy("host").agg(F.collect_list(F.struct("tokens", "classes")).alias("all")).select(
        "host", F.flatten("all.tokens").alias("tokens"), F.flatten("all.classes").alias("classes"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shipped: int = SHIPPED) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Pages without html give an empty text; pages without a host in their url share the host ``''``;
    hosts with too few different pages have no template and are read by structure alone; repeated
    rows are kept and count as pages; an empty table gives an empty result; other columns are
    ignored.  References are decoded, white space in a block becomes one space, blocks are joined
    by one line feed.
    """
    bounded_batches(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    templates = cut_lineage(host_templates(own.select("host", F.coalesce(F.col("page_id").cast("string"), "url", F.lit("")).alias("page"), "html")))
    size = templates.agg(F.sum(2 * F.size("tokens") + 8)).first()[0] or 0
    known = {r["host"]: dict(zip(r["tokens"], r["classes"], strict=True)) for r in templates.collect()} if size <= shipped else None

    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for hosts, htmls, tokens, classes in batches:
            yield pd.Series([
                main_text(html or "", known.get(h, {}) if known is not None else {} if t is None else dict(zip(t, c, strict=True)))
                for h, html, t, c in zip(hosts, htmls, tokens, classes, strict=True)], dtype=object)

    none = F.lit(None).cast("array<long>")
    joined = own.select("*", none.alias("tokens"), none.alias("classes")) if known is not None else own.join(templates, "host", "left")
    read_udf = F.pandas_udf(read, "string")
    return joined.select("page_id", "url", read_udf("host", "html", "tokens", "classes").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_html_extraction(spark, sf):
    return extract_main_text(table(spark, sf, "pages"))
