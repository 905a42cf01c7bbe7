"""HTML main text by site style trees.

The DOMs of a host's pages are merged: branches at the same path of tags and classes are one node of the host's style
tree. Two entropies over the host's pages make up a node's importance. Presentation: that of the sequences of children
under it (a menu is laid out alike on each page, an article never). Content: how much of its text is new on each page (a
text on every page says nothing, one on a single page says all), times the entropy of its number of words (an advert has
about as many each time, also where its words change), or, where that is larger, its new words a page as a share of those
of the host's richest node. Headings, paragraphs and other parts that hold text themselves, and what is inside a declared article, are judged by how new their
texts are alone. Branches of low importance on enough pages are removed from each page.

What HTML itself or a class, id or role declares to be menu, header, footer, sidebar, notice, advert, form or comment is a
prior: it lowers the importance that the tree gives the node, by more for comments and what is hidden, since readers'
comments are as varied as articles. A declared node on too few pages for entropies has the prior alone. Nothing of a host
that has a tree goes but by its tree; pages of hosts of fewer than MIN_PAGES pages, which have none, lose what is declared.

The merge only counts: (host, node, text or child sequence) summed up per task before the shuffle, so a host with a third
of all pages is not gathered anywhere. Pages are not shuffled unless the list of removed branches is too large to
broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import staged, table, whole

#: Hosts of fewer pages have no tree, and undeclared branches on fewer pages of a host stay; so do those of at least this
#: importance.
MIN_PAGES, MIN_IMPORTANCE = 8, 0.35
#: What the importance of a declared branch is multiplied by: ordinary declarations, and those of comments and hidden parts.
PRIORS = (0.45, 0.2)
#: The weight of content against presentation.
CONTENT = 0.5
#: An entropy counts as full from that of so many pages that all differ.
FULL_PAGES = 64
#: Removed branches (host, path) up to which their list is broadcast.
BROADCAST_ROWS = 200_000
#: Counts that a task holds before it hands them on.
HELD = 200_000

# HTML's elements without end tags, those whose content is raw, and those that stand within a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"article", "aside", "body", "div", "section", "td", "th", "main", "li", "blockquote", "button"}}
# What declares a branch to be no part of the article, or the article itself.
PLAIN_TAGS = set("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu map audio video title".split())
PLAIN_WORDS = set("""ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar widget menu nav
navbar navigation breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal overlay subscribe
subscription newsletter signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies
disqus discussion search pagination pager toolbar skip copyright legal hidden""".split())
PLAIN_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words, roles and tags whose parts may be as varied as articles.
VARIED = set("comment comments commentlist respond reply replies disqus discussion related recommended recommendations hidden popup modal overlay form dialog script style template noscript".split())
ARTICLE_WORDS = set("article post entry story content main body text".split())
#: Words that outweigh those of ARTICLE_WORDS beside them.
STRONG_WORDS = PLAIN_WORDS - {"header", "banner", "legal", "notice", "notices"}

#: Parts that hold text themselves, whose numbers of words and children say nothing.
HOLD_TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody blockquote pre figure figcaption caption address summary".split())

# Possessive: what cannot be a tag is given up at once, so a page with stray quotes takes linear time too.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"']+)")


class Node:
    __slots__ = ("tag", "path", "own", "plain", "article", "children", "texts", "words")

    def __init__(self, tag: str, path: int, own: int, plain: bool, article: bool):
        self.tag, self.path, self.own, self.plain, self.article, self.children, self.texts, self.words = tag, path, own, plain, article, [], [], 0


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def declared(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[int, bool]:
    """Whether a branch is declared no part of the article (2: one that may be as varied as it), and whether it is declared
    the article."""
    names = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()))
    roles = set(attributes.get("role", "").lower().split())
    article = tag in ("article", "main") or bool(roles & {"article", "main"})
    plain = tag in PLAIN_TAGS or (tag == "header" and not in_article) or bool(roles & PLAIN_ROLES)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
    plain |= hidden
    if names & PLAIN_WORDS and tag not in ("html", "body") and not article:
        plain |= bool(names & STRONG_WORDS) or not names & ARTICLE_WORDS
    return plain * (2 if hidden or VARIED & (names | roles | {tag}) else 1), article


def blocks(html: str) -> tuple[list[tuple[tuple[int, ...], bool, str]], list[Node]]:
    """(paths of the branches that the block is in, whether one of them is declared plain, text) of each block in page
    order, and all nodes. A block is the text between two tags that break a line."""
    found, nodes, line = [], [], []
    stack = [Node("", 0, 0, False, False)]

    def end_block():
        text = " ".join(unescape("".join(line)).split())
        if text:
            found.append((tuple(n.path for n in stack[1:] if n.tag not in INLINE or n.own), stack[-1].plain, text))
            h, words = hashed(text), text.count(" ") + 1
            for n in stack[1:]:
                n.texts.append(h)
                n.words += words
        line.clear()

    def close(tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                end_block()
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    at, raw_end = 0, None
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0][:2] not in ("<!", "<?"):
                line.append(m[0])
            continue
        if m[1]:
            if tag in ("p", "br") or tag not in VOID:
                if tag in INLINE and any(n.tag == tag for n in stack[-8:]) and stack[-1].tag != tag:
                    continue  # misnested: the block goes on
                if tag in INLINE:
                    if stack[-1].tag == tag:
                        if stack[-1].plain and not stack[-2].plain:
                            end_block()
                        stack.pop()
                    continue
                close({tag}, set())
            continue
        attributes = {a[1].lower(): unescape(next((v for v in a.groups()[1:4] if v is not None), "")) if a[1] else "" for a in ATTRIBUTE.finditer(m[3]) if a[1]}
        attributes |= {a[5].lower(): "" for a in ATTRIBUTE.finditer(m[3]) if a[5]}
        if tag in VOID:
            if tag in ("br", "hr"):
                end_block()
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPES["p"])
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], SCOPES[tag])
        up = stack[-1]
        plain, article = declared(tag, attributes, up.article)
        if tag not in INLINE or plain:
            end_block()
        # Numbers of pages and posts are no part of a style; q1 and q2 are.
        mark = re.sub(r"\d{3,}", "0", f"{tag}.{attributes.get('class', '')}") + re.sub(r"\d+", "0", f"#{attributes.get('id', '')}")
        node = Node(tag, hashed(f"{up.path}/{mark}"), plain, bool(plain) or up.plain, article or up.article)
        up.children.append(mark)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and tag not in INLINE and tag in ("svg", "path"):
            continue
        stack.append(node)
        nodes.append(node)
    end_block()
    return found, nodes


def host(url: str | None) -> str:
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


#: Kinds of counts: pages that have the node; pages that have a text in it; pages by the sequence of children under it; pages
#: by the number of words in it; pages where it is the declared article, which always stays; and pages where it is declared
#: plain, by how strongly. The node 0 is the host itself.
PAGES, TEXT, CHILDREN, WORDS, ARTICLE, PLAIN = range(6)
HOST = 0


def count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (host, path, kind, value)."""
    counts: Counter = Counter()

    def rows():
        out = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "path", "kind", "value", "n"])
        counts.clear()
        return out

    for batch in batches:
        for url, html in zip(batch["url"], batch["html"]):
            at, page = host(url), {}
            for n in blocks(html or "")[1]:
                if n.tag in ("html", "body") or not n.own and (n.tag in INLINE or (n.article and n.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"))):
                    continue
                seen = page.setdefault(n.path, [set(), [], 0, n.article or n.tag in HOLD_TEXT, n.tag in ("article", "main"), 0])
                seen[5] = max(seen[5], n.own)
                seen[0].update(n.texts)
                seen[1] += n.children
                seen[2] += n.words
            counts[at, HOST, PAGES, 0] += 1
            for path, (texts, styles, words, by_text, article, own) in page.items():
                if own:
                    counts[at, path, PLAIN, own] += 1
                counts[at, path, PAGES, 0] += 1
                counts[at, path, WORDS, words] += 1
                if article:
                    counts[at, path, ARTICLE, 0] += 1
                for t in texts:
                    counts[at, path, TEXT, t] += 1
                if not by_text:
                    counts[at, path, CHILDREN, hashed("|".join(styles))] += 1
            if len(counts) > HELD:
                yield rows()
    yield rows()


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance and prior (null if it is not declared plain) of each node of the style trees of hosts of
    MIN_PAGES pages or more, and of each such host itself (the path HOST, without an importance)."""
    counts = pages.select("url", "html").mapInPandas(count_task, "host string, path long, kind int, value long, n long")
    total = counts.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    n, weight = F.col("n"), F.col("n") * F.log("n")
    nodes = total.groupBy("host", "path").agg(
        of(PAGES, n).alias("pages"), of(TEXT, n).alias("texts"), of(TEXT, weight).alias("spread"), of(CHILDREN, n).alias("judged"), of(CHILDREN, weight).alias("styles"), of(ARTICLE, n).alias("articles"),
        of(WORDS, weight).alias("extents"), of(WORDS, n * F.col("value")).alias("words"), F.max(F.when(F.col("kind") == PLAIN, F.col("value"))).alias("declared"),
    )
    log_pages = F.log(F.greatest("pages", F.lit(2)))
    entropy = lambda x: F.least(F.lit(1.0), (F.log("pages") - F.col(x) / F.col("pages")) / F.least(log_pages, F.log(F.lit(FULL_PAGES))))
    new = F.when(F.col("texts") > 0, 1 - F.col("spread") / F.col("texts") / log_pages).otherwise(0.0)
    nodes = nodes.withColumn("new", new).withColumn("new_words", F.col("words") * F.col("new") / F.col("pages"))
    hosts = nodes.groupBy("host").agg(F.max(F.when(F.col("path") == HOST, F.col("pages"))).alias("host_pages"), F.max(F.when(F.col("pages") >= MIN_PAGES, F.col("new_words"))).alias("most"))
    nodes = nodes.join(hosts.filter(F.col("host_pages") >= MIN_PAGES), "host")
    share = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("new_words") / F.col("most"))).otherwise(0.0)
    both = CONTENT * F.greatest(F.col("new") * entropy("extents"), share) + (1 - CONTENT) * entropy("styles")
    merged = F.when(F.col("articles") > 0, 1.0).when(F.col("judged") > 0, both).otherwise(F.col("new"))
    prior = F.when(F.col("declared") == 1, PRIORS[0]).when(F.col("declared") == 2, PRIORS[1])
    importance = F.when(prior.isNull(), merged).when(F.col("pages") >= MIN_PAGES, merged * prior).otherwise(0.0)
    return nodes.select("host", "path", "pages", F.when(F.col("path") != HOST, importance).alias("importance"), prior.alias("prior"))


def extract_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of pages without the branches that their host's tree removes; where there is no tree (removed is null), without
    those that are declared plain."""
    for batch in batches:
        texts = []
        for html, removed in zip(batch["html"], batch["removed"]):
            tree = removed is not None
            gone = set(removed) if tree else set()
            texts.append(" ".join(t for paths, plain, t in blocks(html or "")[0] if not (not gone.isdisjoint(paths) if tree else plain)))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def removed_branches(tree: DataFrame) -> DataFrame:
    """host and path of what the trees remove, and each tree's host itself."""
    goes = ((F.col("pages") >= MIN_PAGES) | F.col("prior").isNotNull()) & (F.col("importance") < MIN_IMPORTANCE)
    return tree.filter((F.col("path") == HOST) | goes).select("host", "path")


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    White space within a block becomes one space, blocks are joined by one space in page order. Null and empty html, and
    pages without an article, give the empty text. Pages of null or odd urls are one host. Repeated rows and null ids get
    rows of their own; other columns are ignored; no pages, no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    low = staged(removed_branches(style_tree(pages)), "removed")
    name = F.lower(F.regexp_extract(whole("url"), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    few = low.count() <= BROADCAST_ROWS
    removed = low.groupBy("host").agg(F.collect_set("path").alias("removed"))
    joined = pages.withColumn("host", name).join(F.broadcast(removed) if few else removed, "host", "left")
    return joined.select("page_id", "url", "html", "removed").mapInPandas(extract_task, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
