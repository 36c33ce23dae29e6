"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by their running text. The best one, or the element around it that holds the
rest of the article, votes for its generalised path (tags and classes from the root, digits made
equal), the votes are counted per host, and every page is
extracted again from the elements on the winning path of its host that holds most of the page's running
text, or from its own container if it has none of them, or only a small one beside an article.
"""

from __future__ import annotations

import html as references
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, bytes_of, free_name, ship

#: A path wins with this share of a host's votes, so a host has at most 20 of them.
WINNING_SHARE = 0.05
#: A path is no more than a box of the page if it holds less than this share of the page's own container.
BOX_SHARE = 0.5

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED = RAW | set("head nav footer aside form button select menu dialog object audio video canvas fieldset input label".split())
# Words in classes, ids and roles of what is not the article.
DROPPED_WORDS = set(
    "ad adbox ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "commentlist cookies dfp disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain "
    "pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar "
    "signup sidenav skip social sponsor sponsored subscribe subscription taboola toolbar topbar topnav widget widgets".split()
)
COMMENT_WORDS = set("comment comments commentlist reply replies respond".split())
# Words beside one of those above that leave its meaning, and words that turn it.
NEUTRAL_WORDS = set("area bar block box container group inner item items list outer panel region section wrap wrapper".split())
TURNING_WORDS = set("has hide hides no non with without".split())
CONTENT_WORDS = set("article body content entry main post story text".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]{0,9999}"|'[^']{0,9999}')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
ENDS_P = BLOCKS - {"body", "html"}


def named_role(name: list[str], roles: set[str]) -> str | None:
    """Whether a class, id or role of these words names one of `roles`: as a whole, as a part, or not at all."""
    hits = [i for i, w in enumerate(name) if w in roles and not (i and name[i - 1] in TURNING_WORDS)]
    if not hits:
        return None
    return "whole" if all(w in DROPPED_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in name) else "part"


class Node:
    __slots__ = ("dropped", "hard", "label", "parent", "part", "tag", "words")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        found = {}
        if attributes and "=" in attributes:
            for name, *values in NAMED.findall(attributes):
                found.setdefault(name.lower(), next((v for v in values if v), ""))
        classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
        names = [[w.lower() for w in WORD.findall(name)] for v in found.values() for name in v.split()]
        self.words = {w for name in names for w in name}
        self.label = ".".join([tag, *classes])
        whole = self.part = False
        if tag not in ("html", "body", "main"):
            for name in names:
                role = named_role(name, COMMENT_WORDS if tag == "article" else DROPPED_WORDS)
                whole, self.part = whole or role == "whole", self.part or role == "part"
        #: Dropped whatever it holds; `part` only drops what does not carry most of the page (see `runs`).
        self.hard = tag in DROPPED or whole or (parent is not None and parent.hard)
        self.dropped = self.hard or self.part or (parent is not None and parent.dropped)

    def path(self) -> str:
        labels, node = [], self
        while node is not None and node.tag not in ("html", "#root"):
            labels.append(node.label)
            node = node.parent
        return "/".join(reversed(labels)) or "#root"

    def container(self) -> Node:
        node = self
        while node.parent is not None and node.tag not in CONTAINERS:
            node = node.parent
        return node

    def within(self, *tags: str) -> bool:
        node = self
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False


def free_carriers(nodes: list[Node], found: list[tuple[Node, str | None]]) -> None:
    """Take back the drop of elements that only a part of a name drops, where they carry most of the page."""
    sizes: dict[int, int] = {}
    total = 0
    for node, text in found:
        size = 0 if not text or node.hard or node.within("a") else len(text.strip())
        total += size
        while size and node is not None:
            sizes[id(node)] = sizes.get(id(node), 0) + size
            node = node.parent
    for node in nodes:
        node.part = node.part and 2 * sizes.get(id(node), 0) <= total
        node.dropped = node.hard or node.part or (node.parent is not None and node.parent.dropped)


def runs(page: str) -> list[tuple[Node, str | None]]:
    """Runs of text with the element they stand in, in page order; None where a block begins or ends."""
    root = Node("#root", "", None)
    out: list[tuple[Node, str | None]] = []
    stack, place = [root], 0
    nodes = [root]
    while True:
        found = TAG.search(page, place)
        text = page[place : found.start() if found else len(page)]
        if text:
            out.append((stack[-1], text))
        if not found:
            if any(n.part and not n.hard for n in nodes):
                free_carriers(nodes, out)
            return out
        place = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing = found[1] or found[4]
        if name in BLOCKS:
            out.append((stack[-1], None))
        elif name == "br":
            out.append((stack[-1], " "))
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINERS and name not in BLOCKS:
                    break
            continue
        attributes = found[3] or found[6] or ""
        if name in VOID or attributes.endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        if name in ENDS_P or name in ("li", "td", "th", "tr", "dt", "dd"):
            own = {name} if name in ("li", "td", "th", "tr", "dt", "dd") else set()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in own:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        stack.append(Node(name, attributes, stack[-1]))
        nodes.append(stack[-1])


def best_container(found: list[tuple[Node, str | None]]) -> Node | None:
    """The container with most running text: its own and half of that one level below."""
    scores: dict[int, list] = {}
    for node, text in found:
        if not text or node.dropped:
            continue
        size = len(text.strip())
        if size and not node.within("a"):
            holder = node.container()
            scores.setdefault(id(holder), [0.0, len(scores), holder])[0] += size
            if holder.parent is not None:
                above = holder.parent.container()
                scores.setdefault(id(above), [0.0, len(scores), above])[0] += size / 2
    if not scores:
        return None

    def rank(x):
        bonus = 1.5 if x[2].tag in ("article", "main") else 1.25 if x[2].words & CONTENT_WORDS else 1.0
        return (-x[0] * bonus, x[1])

    return min(scores.values(), key=rank)[2]


def whole_article(best: Node | None, found: list[tuple[Node, str | None]]) -> Node | None:
    """The element with all of the article that `best` is of: the highest article or main around it, if links
    are not most of its text; without one, the highest element that adds running text and is mostly such.

    Site headers add nothing. The body is taken only for running text of its own, as its other children
    may be anything.
    """
    if best is None or best.tag in ("html", "#root"):
        return best
    above = []
    node = best
    while node is not None and node.tag not in ("html", "#root"):
        above.append(node)
        node = node.parent
    places = {id(n): i for i, n in enumerate(above)}
    # Running text and text of links by the lowest of these elements around it.
    running, linked = [0] * len(above), [0] * len(above)
    loose = 0
    for node, text in found:
        size = 0 if not text or node.dropped else len(text.strip())
        if not size:
            continue
        holder = node
        while holder is not None and id(holder) not in places:
            holder = holder.parent
        if holder is None:
            continue
        at = places[id(holder)]
        if node.within("a"):
            linked[at] += size
        elif node.within("article", "main") or not node.within("header"):
            running[at] += size
            if above[at].tag == "body" and node.container() is above[at]:
                loose += size
    for i in range(len(above) - 1, -1, -1):
        if above[i].tag in ("article", "main") and (sum(linked[: i + 1]) <= sum(running[: i + 1]) or above[i].tag == "article"):
            return above[i]
    now = 0
    for i in range(1, len(above)):
        if sum(linked[: i + 1]) > sum(running[: i + 1]):
            break
        if sum(running[now + 1 : i + 1]) and (above[i].tag != "body" or loose):
            now = i
    return above[now]


def extract(page: str, paths: list[str], shared: bool = False) -> str:
    """Text blocks, joined by line ends, of the elements on that of the paths with most running text here.

    The page's own container is taken if the page has none of the paths, or if that path is only a box beside
    it, and it is an article, main or `shared`: voted for by other pages of the host, too. A large
    container of this page alone may be anything, so there the path wins.
    """
    found = runs(page)
    known: dict[int, str] = {}
    for node, _ in found:
        above = node
        while above is not None and id(above) not in known:
            known[id(above)] = above.path()
            above = above.parent
    own = whole_article(best_container(found), found)
    own_path = known[id(own)] if own is not None else None
    path = own_path if own_path in paths else None
    here = set(known.values())
    have = [p for p in paths if p in here]
    if have and (path is None or len(have) > 1):
        sizes = dict.fromkeys([*have, own_path], 0)
        for node, text in found:
            size = 0 if not text or node.dropped or node.within("a") else len(text.strip())
            while size and node is not None:
                if known[id(node)] in sizes:
                    sizes[known[id(node)]] += size
                node = node.parent
        path = max(have, key=lambda p: sizes[p])  # the first of equal ones has most votes
        article = own is not None and (shared or own.tag in ("article", "main"))
        if article and sizes[path] < BOX_SHARE * sizes[own_path]:
            path = None
    if path is None and own is None:
        return ""
    inside: dict[int, bool] = {}

    def chosen(node: Node | None) -> bool:
        if node is None:
            return False
        if id(node) not in inside:
            here = known[id(node)] == path if path else node is own
            inside[id(node)] = here or chosen(node.parent)
        return inside[id(node)]

    blocks, block = [], []
    for node, text in found:
        if text is None:
            blocks.append(block)
            block = []
        elif not node.dropped and chosen(node) and (not node.within("header") or node.within(*HEADINGS)):
            block.append(text)
    lines = (" ".join(references.unescape("".join(b)).split()) for b in [*blocks, block] if b)
    return "\n".join(line for line in lines if line)


def vote(page: str) -> str | None:
    found = runs(page)
    best = whole_article(best_container(found), found)
    return best.path() if best is not None else None


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def winning_paths(counts: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(host, paths): of (host, path, n), the paths with at least `share` of a host's votes, most votes first."""
    totals = counts.groupBy("host").agg(F.sum("n").alias("total"))
    strong = counts.join(totals, "host").where(F.col("n") >= F.lit(share) * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return strong.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def minor_paths(counts: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(host, path): the paths that more than one page votes for, but fewer than `share` of the host's."""
    totals = counts.groupBy("host").agg(F.sum("n").alias("total"))
    return counts.join(totals, "host").where((F.col("n") > 1) & (F.col("n") < F.lit(share) * F.col("total"))).select("host", "path")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", share: float = WINNING_SHARE) -> DataFrame:
    """Every row and column of `pages` with text and n_chars, its length in code points.

    A null or empty page, or one without any text, gives an empty text. Pages whose url is null or names
    no host vote together. Rows are never grouped or dropped, however often they repeat; an empty table
    gives no rows. Columns of `pages` with the names of the results are replaced. The winning paths of all
    hosts are written first, so that the planner joins them by their known size; pages are not
    shuffled unless that size forbids to broadcast it. The same holds for the paths below `share` that
    several pages vote for; only if there are any, each page's vote is taken again to look it up.
    """
    spark = pages.sparkSession
    ship(spark)
    host, paths, voted, own, minor = (free_name(pages, n) for n in ("page_host", "page_paths", "page_vote", "page_own", "page_minor"))

    @F.pandas_udf("string")
    def best(bodies: pd.Series) -> pd.Series:
        return pd.Series([vote(b.decode("utf-8", "replace")) for b in bodies], dtype=object)

    @F.pandas_udf("string")
    def extracted(bodies: pd.Series, wanted: pd.Series, shared: pd.Series) -> pd.Series:
        rows = zip(bodies, wanted, shared)
        return pd.Series([extract(b.decode("utf-8", "replace"), [] if w is None else list(w), bool(s)) for b, w, s in rows], dtype=object)

    hosted = pages.withColumn(host, host_of(F.col(url)))
    votes = hosted.select(F.col(host).alias("host"), best(bytes_of(html)).alias("path")).where(F.col("path").isNotNull())
    scratch = Scratch(spark, "html")
    counts = scratch.keep(votes.groupBy("host", "path").agg(F.count("*").alias("n")), "counts")
    winners = scratch.keep(winning_paths(counts, share), "paths")
    winners = winners.select(F.col("host").alias(voted), F.col("paths").alias(paths))
    joined = hosted.join(winners, F.col(host) == F.col(voted), "left").drop(voted)
    below = scratch.keep(minor_paths(counts, share), "minor")
    shared = F.lit(False)
    if not below.isEmpty():
        below = below.select(F.col("host").alias(voted), F.col("path").alias(minor))
        joined = joined.withColumn(own, best(bytes_of(html)))
        joined = joined.join(below, (F.col(host) == F.col(voted)) & (F.col(own) == F.col(minor)), "left")
        shared = F.col(minor).isNotNull()
    done = joined.withColumn("text", extracted(bytes_of(html), F.col(paths), shared))
    return done.withColumn("n_chars", F.length("text").cast("long")).drop(host, paths, voted, own, minor)
