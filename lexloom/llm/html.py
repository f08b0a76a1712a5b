"""Main text of web pages by site style trees.

Pages of a host are merged into a tree of styles: a node is a tag with its class or id
below its parent's node. For every node the tree keeps, over distinct pages, how its
presentation (the sequence of styles of its children) and its content (the texts it
holds itself, in order) spread, and how much of its text is links. Pages of equal
content have one vote together, in article and main those of an equal article, so that
copies of whole pages never make their text look like what repeats on a site.

Entropy, as a share of its maximum, gives importance: a node's own text is important as
far as it differs from page to page and is not links. A branch's importance blends the
importance of all text in it, weighed by its length, with the presentation entropy of
its inner nodes, which count less the deeper they lie. The tree decides first: a node's
text goes if its own importance is low, a branch goes whole if the branch's importance
is low, unless it is a page's frame: html, body, what holds an article or main, or what
holds most of the important text of the host. What then still bears a name of
boilerplate (navigation, header, footer, advert, notice, comments ...) goes too: names
tell where statistics cannot, on hosts with fewer than ``LEAST_PAGES`` distinct pages
and where boilerplate, say comments, differs on every page. On a page that marks its
article, the main text is what is left in it; in it, the tree takes away only what stands
on every page alike, and a name counts only whole and only if it is hardly the article's own.

Defined results: null or empty html gives an empty text; pages without a host share
one tree; repeated rows are repeated pages; an empty table gives no rows; further
columns are ignored. Work and memory grow with the length of a page, however deep its
tags nest and whatever quotes stay open.
"""

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import keep, text_of

# Elements whose content is no text, elements that open a block, void elements.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "textarea", "title", "head"}
BLOCKS = set("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "input"}
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer|header|masthead|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|"
    r"comment\w*|disqus|replies|reply|respond|related|recommend\w*|share|sharing|social|widget\w*|pagination|pager|toolbar|login|search|alert|gdpr|toc|copyright)(?:$|[\s_-])", re.I,
)
# Inside article and main a name counts only whole, and only where it can hardly be the article's own.
BOILER_INSIDE = re.compile(
    r"(?:^|\s)(?:ad|ads|advert\w*|sponsor\w*|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|cookies?|consent|popup|newsletter|"
    r"comments?|comments?-list|comment-section|disqus|replies|related|recommended|share|sharing|social|pagination|pager|gdpr)(?:$|\s)", re.I,
)
MAIN, FRAME = {"article", "main"}, {"html", "body"}
TOKENS = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[^<]+|<", re.S)
STOPS = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE = re.compile(r"\s+")
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"br", "body", "html"}

LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.35
LEAST_INSIDE = 0.05  # of text in article and main: only what stands on every page alike
CONTENT = 0.8  # its weight in a branch's importance; the rest is presentation
DECAY = 0.5  # of presentation for each level down
REACH = 16  # levels above a node that its statistics reach


def tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; a quote that never closes is an ordinary character."""
    while m := STOPS.search(page, at):
        at = m.end()
        if m.group() == ">":
            return at
        close = page.find(m.group(), at)
        at = close + 1 if close >= 0 else at
    return len(page)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Node:
    """An open element: its tag, its node in the style tree, what it inherits, its children's nodes."""

    __slots__ = ("tag", "node", "bad", "main", "frame", "gone", "children")

    def __init__(self, tag, node, bad, main, frame, gone):
        self.tag, self.node, self.bad, self.main, self.frame, self.gone, self.children = tag, node, bad, main, frame, gone, []


def blocks(page: str, branches=frozenset(), seen: dict | None = None) -> list[tuple[int, bool, bool, bool, str, int]]:
    """Blocks in page order: (node, named as boilerplate, in article or main, in one of ``branches``, text, characters of it in links).

    ``seen`` collects per node: the nodes above it, itself first; whether it is a frame or holds nothing but article text; its presentations.
    """
    from xxhash import xxh64_intdigest as xxh

    out, text, linked, link = [], [], 0, 0
    root = Node("", 0, False, False, True, False)
    stack, count, endless = [root], Counter(), set()

    def flush():
        nonlocal linked
        t = WHITE.sub(" ", entities.unescape("".join(text))).strip() if text else ""
        if t:
            top = stack[-1]
            out.append((top.node, top.bad, top.main, top.gone, t, linked))
            if seen is not None and top is root:
                seen.setdefault(0, [[0], True, False, []])
        text.clear()
        linked = 0

    def shut():
        x = stack.pop()
        count[x.tag] -= 1
        if seen is not None and x.children:
            seen[x.node][3].append(xxh(repr(x.children)))

    at, n = 0, len(page)
    while at < n:
        m = TOKENS.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            s = m.group()
            if s[0] != "<" or s == "<":
                text.append(s)
                if link:
                    linked += len(s.strip())
            continue
        attrs, at = at, tag_end(page, at)
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                link = max(0, link - 1)
            if tag not in BLOCKS or not count[tag]:
                continue
            flush()
            while True:
                last = stack[-1].tag == tag
                shut()
                if last:
                    break
        elif tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else at if tag == "head" else n
        elif tag == "a":
            link += 1
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            while stack[-1].tag in closes:
                shut()
            named = page[attrs : at - 1]
            names = " ".join(x or y or z for x, y, z in NAMES.findall(named)) if "=" in named else ""
            up = stack[-1]
            own = tag in BOILER_TAGS or (tag == "header" and not up.main) or (tag not in FRAME and bool((BOILER_INSIDE if up.main else BOILER_NAMES).search(names)))
            node = signed(xxh(f"{tag}.{names}" if names else tag, up.node % (1 << 64)))
            up.children.append(node)
            x = Node(tag, node, up.bad or own, up.main or tag in MAIN, tag in FRAME, up.gone or node in branches)
            stack.append(x)
            count[tag] += 1
            if seen is not None and node not in seen:
                seen[node] = [[y.node for y in stack[: -REACH - 1 : -1]], x.frame, x.main, []]
    flush()
    while len(stack) > 1:
        shut()
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def digest(parts: list) -> int:
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")))


ROWS = "host string, node long, kind int, value long, vote long, up array<long>, frame boolean, main boolean, chars long, linked long"


def style_rows(pages: DataFrame) -> DataFrame:
    """One row a page, node and kind (0: its own texts, 1: its presentation); value and vote are hashes, the vote of the whole page
    or of its article."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for h, page in zip(b["host"], b["html"]):
                whole, inner, by, seen = [], [], {}, {}
                for node, _, main, _, t, k in blocks(page, seen=seen):
                    whole += (node, t)
                    if main:
                        inner += (node, t)
                    own = by.setdefault(node, [[], 0])
                    own[0].append(t)
                    own[1] += min(k, len(t))
                votes = digest(whole), digest(inner)
                for node, (up, frame, main, shapes) in seen.items():
                    if shapes:
                        rows.append((h, node, 1, digest(shapes), votes[main], up, frame, main, 0, 0))
                    if node in by:
                        ts, k = by[node]
                        rows.append((h, node, 0, digest(ts), votes[main], up, frame, main, sum(map(len, ts)), k))
            yield pd.DataFrame(rows, columns=names)

    return pages.select("host", "html").mapInPandas(run, ROWS)


def nodes(pages: DataFrame) -> DataFrame:
    """(host, node, n, content, presentation, chars, up, frame, main): n counts distinct pages; content is the importance of the node's
    own text (null: none), presentation the entropy of its children's sequences (null: no children). Sums combine before each
    shuffle, so a common host is no single group."""
    node = ["host", "node"]
    own = [F.first(c).alias(c) for c in ("up", "frame", "main")]
    votes = style_rows(pages).groupBy(*node, "kind", "value", "vote").agg(*own, F.min("chars").alias("chars"), F.min("linked").alias("linked"))
    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    each = votes.groupBy(*node, "kind", "value").agg(*own, F.count("*").alias("k"), *sums)
    kinds = each.groupBy(*node, "kind").agg(*own, F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s"), *sums)
    spread = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    links = F.when(F.col("main"), 0.0).otherwise(F.col("linked") / F.greatest("chars", F.lit(1)))
    value = F.when(F.col("kind") == 1, spread).otherwise(spread * (1 - links))
    x = kinds.select(*node, "kind", "n", value.alias("v"), "chars", "up", "frame", "main")
    return x.groupBy(*node).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("content"), F.max(F.when(F.col("kind") == 1, F.col("v"))).alias("presentation"),
        F.sum("chars").alias("chars"), *own,
    )


def importance(x: DataFrame) -> DataFrame:
    """(host, node, n, content, branch, frame): adds to ``nodes`` the importance of the branch, from all nodes below within
    ``REACH`` levels; frame: must not go as a branch."""
    good = F.col("chars") * F.coalesce("content", F.lit(0.0))
    each = x.select("host", "n", "content", "presentation", "chars", "frame", "main", good.alias("good"), F.posexplode("up").alias("d", "node"))
    near, inner = F.pow(F.lit(DECAY), F.col("d")) * F.col("n"), F.col("presentation").isNotNull()
    own = lambda c: F.max(F.when(F.col("d") == 0, F.col(c)))
    sub = each.groupBy("host", "node").agg(
        own("n").alias("n"), own("content").alias("content"), F.max(F.when(F.col("d") == 0, F.col("frame"))).alias("frame"), F.max("main").alias("main"),
        F.sum("chars").alias("chars"), F.sum("good").alias("good"), F.sum(F.when(inner, near * F.col("presentation"))).alias("p"), F.sum(F.when(inner, near)).alias("w"),
    )
    text = F.when(F.col("chars") > 0, F.col("good") / F.col("chars"))
    branch = F.when(F.col("w").isNull(), text).otherwise(CONTENT * F.coalesce(text, F.lit(0.0)) + (1 - CONTENT) * F.col("p") / F.col("w"))
    whole = x.groupBy("host").agg(F.sum(good).alias("whole"))
    frame = F.coalesce("frame", F.lit(False)) | F.col("main") | (F.col("good") > 0.5 * F.col("whole"))
    return sub.join(whole, "host").select("host", "node", "n", "content", branch.alias("branch"), frame.alias("frame"))


def unimportant(x: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, texts, branches, inside): nodes of each host whose own text goes, whose whole branch does, and whose own text goes even
    in an article."""
    told = F.col("n") >= least_pages
    x = x.withColumn("t", told & (F.col("content") < least)).withColumn("b", told & ~F.col("frame") & (F.col("branch") < least)).filter("t or b")
    x = x.withColumn("i", told & (F.col("content") < LEAST_INSIDE))
    lists = (("t", "texts"), ("b", "branches"), ("i", "inside"))
    return x.groupBy("host").agg(*[F.sort_array(F.collect_list(F.when(F.col(c), F.col("node")))).alias(name) for c, name in lists])


def with_dropped(x: DataFrame, low: DataFrame, most_bytes: int = 8 << 20, salts: int = 64) -> DataFrame:
    """Pages with the dropped nodes of their host. A small list is broadcast, so that no html moves; a larger one
    is joined by host and salt, so that a host with very many pages is spread over ``salts`` groups."""
    size = low.agg(F.sum(8 * F.size("texts") + 8 * F.size("branches") + 8 * F.size("inside") + F.length("host"))).first()[0] or 0
    if size <= most_bytes:
        return x.join(F.broadcast(low), "host", "left")
    low = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    x = x.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int"))
    return x.join(low, ["host", "_salt"], "left").drop("_salt")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_by_tree) of every page; n_by_tree counts the blocks that the style tree removed."""
    x = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), text_of("html").alias("html"))
    x = with_dropped(x, keep(unimportant(importance(keep(nodes(x))))))

    def run(batches):
        for b in batches:
            out, by_tree = [], []
            for page, texts, branches, inside in zip(b["html"], b["texts"], b["branches"], b["inside"]):
                low, fixed = (set(v) if v is not None else () for v in (texts, inside))
                found = blocks(page, frozenset(branches) if branches is not None else frozenset())
                kept = [x for x in found if (x[0] not in fixed if x[2] else not x[3] and x[0] not in low)]
                by_tree.append(len(found) - len(kept))
                kept = [x for x in kept if not x[1]]
                out.append("\n".join(x[4] for x in ([x for x in kept if x[2]] or kept)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_by_tree": by_tree})

    return x.select("page_id", "url", "html", "texts", "branches", "inside").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_by_tree long")
