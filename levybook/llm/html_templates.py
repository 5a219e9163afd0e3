"""Main text of web pages by removing the template of their site.

Every block element's subtree is hashed twice: with its text, and by structure alone
(tags, classes and ids, no text and no links' targets). Spark counts in how many
different pages of a host each hash occurs. Subtrees that recur are the host's template
and are deleted; a structure outside the article recurs as template where its words are
few or stand in links, so menus and adverts go whose words differ from page to page.
Besides, what HTML itself marks as not being the article goes (scripts, forms, menus).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

# Fixed values of HTML: element kinds, and words that name page parts in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|canvas|audio|video|xmp"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article main section div td th".split())
NOT_ARTICLE = frozenset("nav footer aside form button input fieldset dialog menu head".split())
OUTSIDE = frozenset("label".split())   # no article outside of one
PARTS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
                  "cookie-banner cookie-consent cookie-notice disqus_thread footer gdpr login main-nav masthead menu modal nav navbar navigation newsletter notice notices "
                  "outbrain pagination popup promo promo-box promotion reader-comments related respond search share sharing sidebar signup site-footer site-header "
                  "site-nav skip-link social sponsor sponsored subscribe taboola toolbar widget".split())
PARTS_INSIDE = frozenset("ad ads advert adverts advertisement adsense comments commentlist comment-list disqus_thread reader-comments share sharing".split())
PART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
                   r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.I | re.S)
ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose structure is counted, if they are named or their words stand in links; and the mean of words that are few.
CONTAINER = frozenset("aside center details dialog div dl fieldset footer form header menu nav ol section table ul".split())
FEW_WORDS = 25


class Node:
    __slots__ = ("tag", "attrs", "kids", "closed")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.closed = tag, attrs, [], False


def parse(source: str) -> Node:
    """The element tree; never fails. Missing end tags are implied the way browsers imply the common ones."""
    root = Node("#root")
    stack, at = [root], 0

    def close(tag: str, within: frozenset | None = None, explicit: bool = True) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                stack[i].closed = explicit
                del stack[i:]
                return
            if within and stack[i].tag in within:
                return

    for m in TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].kids.append(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                stack[-1].kids.append(" ")
            elif tag == "p":
                close("p", frozenset({"article", "body", "td", "th"}))
            else:
                close(tag)
            continue
        if tag in ("article", "main"):   # an article is never inside an unclosed menu, notice or form
            for i in range(1, len(stack)):
                if not_article(stack[i]):
                    del stack[i:]
                    break
        if tag in ENDS_P:
            close("p", SCOPE)
        for other in CLOSED_BY.get(tag, ()):
            close(other, SCOPE - {"td", "th"} if tag == "tr" else SCOPE - {other})
        node = Node(tag, m["attrs"].strip())
        stack[-1].kids.append(node)
        if tag not in VOID and not node.attrs.endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].kids.append(source[at:])
    return root


def names_of(node: Node) -> tuple[set[str], str, bool]:
    """Classes and id of an element, its role, and whether it is hidden."""
    names, role, hidden = set(), "", False
    for name, a, b, c in ATTR.findall(node.attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id"):
            names.update(value.split())
        elif name == "role":
            role = value
        elif name == "hidden":
            hidden = True
    return names, role, hidden


def not_article(node: Node, inside: bool = False) -> bool:
    """Whether HTML or its class, id or role says that the element is no part of the article.

    Names count as whole words only, and inside an article only the plainest do."""
    if node.tag in NOT_ARTICLE or node.tag in OUTSIDE and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    names, role, hidden = names_of(node)
    if hidden:
        return True
    if node.tag in ("article", "main"):
        return bool(names & PARTS_INSIDE)
    return not names.isdisjoint(PARTS_INSIDE if inside else PARTS) or role in PART_ROLES


def nodes(root: Node) -> list[Node]:
    """All elements, parents before children; iterative, as pages may be nested deeper than Python's stack."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(k for k in n.kids if isinstance(k, Node))
    return order


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def block_digests(order: list[Node]) -> dict[int, int]:
    """By node: the hash of every block subtree. An article, and what an article is in, has none: it is never cut as a whole."""
    from xxhash import xxh3_64_intdigest
    sign: dict[int, str] = {}
    around: set[int] = set()
    found: dict[int, int] = {}
    for n in reversed(order):
        text = "\x01".join(sign[id(k)] if isinstance(k, Node) else " ".join(k.split()) for k in n.kids)
        digest = xxh3_64_intdigest(f"{n.tag}\x00{n.attrs}\x00{text}")
        sign[id(n)] = f"{digest:x}"
        if n.tag in ("article", "main") or any(id(k) in around for k in n.kids):
            around.add(id(n))
        elif n.tag in BLOCK and n.tag not in ("html", "body"):
            found[id(n)] = signed(digest)
    return found


def structures(order: list[Node]) -> dict[int, tuple[int, int, int]]:
    """By node outside articles: hash of its structure, its words, and those of them in links.

    Only containers that have a name or hold mostly links are in it, and none with a
    title; like neighbours count as one, so lists of any length are alike.
    """
    from xxhash import xxh3_64_intdigest
    sign: dict[int, str] = {}
    words: dict[int, tuple[int, int]] = {}
    kept: set[int] = set()   # articles, titles, and what they are in
    found: dict[int, tuple[int, int, int]] = {}
    for n in reversed(order):
        own, linked, parts = 0, 0, []
        for k in n.kids:
            if isinstance(k, Node):
                own, linked = own + words[id(k)][0], linked + words[id(k)][1]
                if not parts or parts[-1] != sign[id(k)]:
                    parts.append(sign[id(k)])
                if id(k) in kept:
                    kept.add(id(n))
            else:
                own += len(k.split())
        if n.tag in ("article", "main", "h1"):
            kept.add(id(n))
        words[id(n)] = own, own if n.tag == "a" else linked
        names = names_of(n)[0] if n.attrs else set()
        digest = xxh3_64_intdigest(f"{n.tag} {' '.join(sorted(names))}\x00{' '.join(parts)}")
        sign[id(n)] = f"{digest:x}"
        if n.tag in CONTAINER and own and id(n) not in kept and (names or n.tag not in ("div", "section", "table") or 2 * linked >= own):
            found[id(n)] = signed(digest), own, linked
    todo, inside = [n for n in order if n.tag in ("article", "main")], set()
    while todo:   # what is in an article is judged by its text alone
        n = todo.pop()
        if id(n) not in inside:
            inside.add(id(n))
            todo += [k for k in n.kids if isinstance(k, Node)]
    return {n: x for n, x in found.items() if n not in inside}


def marked(n: Node, inside: bool) -> bool:
    """Whether the element, inside an article or not, goes by what HTML and its own names say."""
    return n.tag == "header" and not inside or (n.closed or n.tag in VOID or n.tag in ("button", "label", "head")) and not_article(n, inside)


def subtree_hashes(source: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The page's body, its distinct (subtree, unit): hashes of block subtrees that hold text, and its (structure, words, linked words).

    Body is a hash of the words of the page's articles, or of the page where it has none;
    unit that of the innermost article around the subtree, or else the body. Attributes
    and marked parts do not count in them, so copies of an article have the same.
    """
    from xxhash import xxh3_64_intdigest
    root = parse(source or "")
    order = nodes(root)
    gone: set[int] = set()
    article: dict[int, Node | None] = {id(root): None}
    tops: list[Node] = []
    for n in order:
        own = n.tag in ("article", "main")
        if own and article[id(n)] is None and id(n) not in gone:
            tops.append(n)
        for k in n.kids:
            if isinstance(k, Node):
                article[id(k)] = n if own else article[id(n)]
                if id(n) in gone or marked(k, article[id(k)] is not None):
                    gone.add(id(k))
    words: dict[int, str] = {}
    for n in reversed(order):
        parts = ["" if id(k) in gone else words[id(k)] if isinstance(k, Node) else " ".join(k.split()) for k in n.kids]
        text = "\x01".join(p for p in parts if p)
        words[id(n)] = f"{xxh3_64_intdigest(text):x}" if text else ""
    whole = "\x01".join(sorted({words[id(n)] for n in tops} - {""})) or words[id(root)]
    body = signed(xxh3_64_intdigest(whole))
    unit = {id(n): signed(int(words[id(n)], 16)) if words[id(n)] else body for n in set(article.values()) - {None}}
    digests = block_digests(order)
    return body, sorted({(digests[id(n)], unit[id(article[id(n)])] if article[id(n)] else body) for n in order if n.kids and id(n) in digests}, key=lambda x: (x[1], x[0])), sorted(structures(order).values())


def main_text(source: str | None, template: set[int], shapes: set[int] = frozenset()) -> str:
    """Blocks of the page in order, one a line, without ``template`` subtrees, structures in ``shapes``, and what is no article.

    Where nothing else is left, the template subtrees stay."""
    root = parse(source or "")
    cut = {n for n, digest in block_digests(nodes(root)).items() if digest in template} if template else set()
    if shapes:
        cut |= {n for n, (shape, _, _) in structures(nodes(root)).items() if shape in shapes}

    def dropped(n: Node, inside: bool) -> bool:
        return id(n) in cut or marked(n, inside)

    blocks: list[str] = []

    def gather(top: Node, inside: bool) -> None:
        line: list[str] = []

        def flush() -> None:
            if s := " ".join(entities.unescape("".join(line)).split()):
                blocks.append(s)
            line.clear()

        steps: list = [(top, inside)]
        while steps:
            n, within = steps.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif n is not top and dropped(n, within):
                line.append(" ")
            else:
                block = n.tag in BLOCK
                if block:
                    flush()
                    steps.append((None, within))
                elif n.tag in ("br", "td", "th"):
                    line.append(" ")
                within = within or n.tag in ("article", "main")
                steps.extend((k, within) for k in reversed(n.kids))
        flush()

    # the outermost articles that are no comments, adverts and so on; the whole page where it has none
    tops: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n is not root and marked(n, False):
            continue
        if n.tag in ("article", "main"):
            tops.append(n)
        else:
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    templates = cut
    for starts in (tops, [root]):
        for cut in (templates, set()) if templates else (set(),):
            for top in starts:
                gather(top, top is not root)
            if blocks:
                return "\n".join(blocks)
    return ""


def host_of(url):
    """Host of a URL column, lower case; the empty string without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def page_texts(pages: DataFrame, min_pages: int = 10, min_share: float = 0.5, outer_share: float = 0.1) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A subtree is template when at least ``min_pages`` different pages and ``min_share``
    of all different pages of its host hold it. Pages with the same article count once,
    whatever is around it, and a subtree counts once for all copies of the article that
    it is in; articles themselves are never template. A structure outside the article
    is template from ``min_pages`` different pages and ``outer_share`` on, if its words
    are ``FEW_WORDS`` on average at most or half of them stand in links. Null or empty
    html gives the empty text; pages without a host form one host of their own; repeated
    rows are returned each; other columns are ignored.
    """
    bounded_batches(pages.sparkSession, rows=500)
    base = pages.select("page_id", "url", "html")
    keyed = base.withColumn("host", host_of("url"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [subtree_hashes(h) for h in b["html"]]
            shapes = [list(zip(*x)) or [(), (), ()] for _, _, x in found]
            yield pd.DataFrame({"host": b["host"], "body": [body for body, _, _ in found],
                                "hashes": [[h for h, _ in x] for _, x, _ in found], "units": [[u for _, u in x] for _, x, _ in found],
                                "shapes": [x[0] for x in shapes], "words": [x[1] for x in shapes], "linked": [x[2] for x in shapes]})

    seen = stored(keyed.select("host", "html").mapInPandas(lean(hashes), "host string, body long, hashes array<long>, units array<long>, "
                                                                       "shapes array<long>, words array<int>, linked array<int>"), "subtrees")
    exploded = seen.select("host", "body", F.inline(F.arrays_zip(F.col("hashes").alias("subtree"), F.col("units").alias("unit"))))
    shaped = seen.select("host", "body", F.inline(F.arrays_zip(F.col("shapes").alias("shape"), "words", "linked")))
    sizes = seen.groupBy("host").agg(F.count_distinct("body").alias("host_pages"))
    # most subtrees occur once; only those on enough rows are counted over different pages
    often = stored(exploded.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "subtree"), "frequent-subtrees")
    counted = exploded.join(often, ["host", "subtree"], "left_semi").groupBy("host", "subtree").agg(F.least(F.count_distinct("body"), F.count_distinct("unit")).alias("n"))
    template = counted.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") >= F.col("host_pages") * F.lit(min_share)).select("host", "subtree")
    few = (F.sum("words") <= F.count(F.lit(1)) * FEW_WORDS) | (2 * F.sum("linked") >= F.sum("words"))
    outer = (shaped.groupBy("host", "shape", "body").agg(F.avg("words").alias("words"), F.avg("linked").alias("linked"))
             .groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), few.alias("few")).where((F.col("n") >= min_pages) & F.col("few"))
             .join(sizes, "host").where(F.col("n") >= F.col("host_pages") * F.lit(outer_share)).select("host", "shape"))
    template, outer = stored(template, "templates"), stored(outer, "outer-templates")
    # few a host: at most the mean number of a page's subtrees divided by the share that makes a template
    cuts = template.select("host", "subtree", F.lit(None).cast("long").alias("shape")).unionAll(outer.select("host", F.lit(None).cast("long"), "shape"))
    cuts = stored(cuts.groupBy("host").agg(F.collect_set("subtree").alias("template"), F.collect_set("shape").alias("outer")), "host-templates")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"],
                                "text": [main_text(h, set(t) if t is not None else set(), set(o) if o is not None else set()) for h, t, o in zip(b["html"], b["template"], b["outer"])]})

    out = (keyed.join(cuts, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "template", "outer")
           .mapInPandas(lean(extract), "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
