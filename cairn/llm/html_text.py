"""Main text of web pages, without what a site repeats.

Every element's subtree gets a hash of its tag, classes and contents. Spark counts, for each
host and each section of it, on how many pages a subtree occurs; those on many pages of either are its template and are
deleted where they stand outside the article. Menus, forms, adverts, comments and the like are
left out by tag, role and class, also where a host has too few pages to count. Attributes are
read by name: hidden is only the attribute of that name, display only counts within style.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches, written

# Names of elements, roles and class words.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg canvas object".split())
LEFT_OUT = frozenset("nav footer aside form button select dialog menu head audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CLASSES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social related recommended sidebar newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices notification popup modal overlay breadcrumb breadcrumbs pagination pager menu nav navbar navigation toolbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
OUTER_CLASSES = frozenset("header masthead topbar footer footnav copyright banner alert skip".split())
#: Telling words that also name a page's main part at times; with these alone, the size of the part counts.
WEAK = OUTER_CLASSES | frozenset("widget widgets modal popup overlay notice notices notification promo promotion menu toolbar related recommended social share sharing".split())
#: Words that say no more than that something is a part of a page, or what kind of part.
PARTS = frozenset("area bar block bottom box btn button buttons column container content form global group icon icons inner item items left link links list main message module nav outer overlay page panel post posts primary right row section secondary site strip text thread title top unit widget widgets wrap wrapper".split())
CLOSES_P = BLOCKS - frozenset("br button option select textarea body html head title tbody td tfoot th thead tr caption".split())
#: Tag -> those that its start closes, up to the nearest of the limits.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table td th select article main section body button".split())

#: Quoted values are bounded here, so that a stray quote costs no scan of the whole page; longer ones are left to tag_end().
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]{0,4000}\"|'[^']{0,4000}')[^>\"']*+){0,200}+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile("class|id|role|hidden|style", re.I).search
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I).search
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


MARK = re.compile(r"[>\"']")


def tag_end(page: str, start: int, dead: set[int]) -> int:
    """Past the ">" that ends the tag whose attributes begin at start, or -1; a quote opens a value only after "=".

    dead has the opening quotes from which no end was found, so that a page is scanned once in all.
    """
    opened, at = [], start
    while m := MARK.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while before > start and page[before].isspace():
            before -= 1
        if before < start or page[before] != "=":
            continue
        if m.start() in dead:
            break
        opened.append(m.start())
        at = page.find(m[0], at) + 1
        if not at:
            break
    dead.update(opened)
    return -1


class Frame:
    __slots__ = ("tag", "start", "drop", "soft", "parts", "inner")

    def __init__(self, tag: str, start: int, drop: bool, soft: str, inner: bool, name: str):
        self.tag, self.start, self.drop, self.soft, self.inner, self.parts = tag, start, drop, soft, inner, [name]


def telling(name: str) -> set[str]:
    """The telling words of a class or id, of which every word is telling or a word for a part: sidebar-left and cookieNotice tell, has-sidebar and share-price don't."""
    words = {w.lower() for w in WORDS.findall(name)}
    found = words & (CLASSES | COMMENTS | OUTER_CLASSES)
    return found if found and words <= CLASSES | COMMENTS | OUTER_CLASSES | PARTS else set()


def described(attributes: str) -> tuple[str, set[str], set[str], bool]:
    """Of an element: its class, id and role as written, the telling words of its classes and id, its roles, whether it is hidden; by the names of its attributes, whose first value counts."""
    if not attributes or not TELLING(attributes):
        return "", set(), set(), False
    written_as, words, roles, hidden, met = [], set(), set(), False, set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in met:
            continue
        met.add(name)
        if name in ("class", "id", "role"):
            written_as.append(value)
            if name == "role":
                roles = set(value.lower().split())
            else:
                for token in value.split():
                    words |= telling(token)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN(value):
            hidden = True
    return " ".join(written_as), words, roles, hidden


def parse(page: str, template: frozenset[int] | set[int] = frozenset(), seen: set[int] | None = None) -> str:
    """The page's main text without the subtrees in template; seen gets the hashes of subtrees that could be one.

    Elements that were never closed end with what holds them, as browsers read them. Subtrees
    within an article are not taken for a template, so a passage that many articles quote stays. Attributes count by their names, so
    no word of a link or a title hides its element. What a class or id tells is weighed once the page is read, see kept().
    A main element with text is the main text. Else the articles are, unless a single block outside them is longer
    than they are together, as where an article is a mere teaser; else all that is left is. Work grows with the length of the page.
    """
    import xxhash

    out: list[str] = []
    articles: list[tuple[int, int, bool]] = []  # outermost ones: from, to, whether it is a main
    told: list[tuple[int, int, str]] = []  # what classes tell: from, to, kind
    stack = [Frame("#", 0, False, "", False, "")]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    menus: list[int] = []  # places of what an article's start ends
    depth = 0  # of articles

    def close() -> None:
        nonlocal depth
        f = stack.pop()
        places[f.tag].pop()
        if menus and menus[-1] == len(stack):
            menus.pop()
        digest = xxhash.xxh64_intdigest("\x00".join(f.parts).encode("utf-8", "surrogatepass")) >> 1
        stack[-1].parts.append(str(digest))
        if f.tag in ("article", "main"):
            depth -= 1
        may_repeat = not f.inner and f.tag in BLOCKS and f.tag not in ("body", "html", "article", "main")
        if may_repeat and seen is not None and len(out) > f.start:
            seen.add(digest)
        if f.drop or may_repeat and digest in template:
            del out[f.start :]
            while articles and articles[-1][1] > f.start:
                articles.pop()
            while told and told[-1][1] > f.start:
                told.pop()
        else:
            if f.tag in ("article", "main") and depth == 0:
                articles.append((f.start, len(out), f.tag == "main"))
            if f.soft:
                told.append((f.start, len(out), f.soft))
        if f.tag in BLOCKS:
            out.append(" ")

    def close_through(tags: tuple[str, ...], limits: frozenset[str]) -> None:
        """Close the outermost of tags that is open above the nearest limit."""
        limit = max((places[t][-1] for t in limits if places[t] and t not in tags), default=0)
        found = [own[i] for t in tags if (own := places[t]) and (i := bisect_right(own, limit)) < len(own)]
        while found and len(stack) > min(found):
            close()

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    dead: set[int] = set()
    while at < end:
        m = TAG.search(page, at, last) if at < last else None
        upto = m.start() if m else end
        if upto > at:
            text = page[at:upto]
            out.append(entities.unescape(text) if "&" in text else text)
            stack[-1].parts.append(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if places[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                out.append(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        if m[5] and (past := tag_end(page, m.end(5), dead)) > 0:
            attributes, at = page[m.end(5) : past - 1], past
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if closed:
                at = closed.end()
            elif tag in ("script", "style"):
                at = end
            continue
        if tag in VOID:
            if tag in BLOCKS:
                out.append(" ")
            continue
        if tag in ("article", "main"):  # ends a menu or advert that was never closed
            while menus:
                close()
        if tag in CLOSES_P and places["p"]:
            close_through(("p",), LIMITS)
        if tag in CLOSES and any(places[t] for t in CLOSES[tag]):
            close_through(CLOSES[tag], LIMITS - frozenset(CLOSES[tag]))
        name, words, roles, hidden = described(attributes or "")
        inner = stack[-1].inner or stack[-1].tag in ("article", "main")
        drop = tag not in ("html", "body", "main") and (tag in LEFT_OUT or hidden or tag == "header" and not inner or bool(roles & ROLES))
        soft = ""
        if words and tag not in ("html", "body", "main"):
            words -= OUTER_CLASSES if inner else set()
            soft = "sure" if words - WEAK else "weak" if words else ""
        if tag in BLOCKS:
            out.append(" ")
        stack.append(Frame(tag, len(out), drop, soft, inner, f"{tag}.{name}"))
        places[tag].append(len(stack) - 1)
        if drop and not menus and tag in ("nav", "header", "head", "div", "section", "footer"):
            menus.append(len(stack) - 1)
        if tag in ("article", "main"):
            depth += 1
    while len(stack) > 1:
        close()
    out = kept(out, articles, told)
    text = lambda parts: " ".join("".join(parts).split())
    main = text(x for a, b, is_main in articles if is_main for x in out[a:b])
    if main:
        return main
    own = text(x for a, b, _ in articles for x in out[a:b])
    if own:
        longest = size = at = 0
        for a, b in [*((a, b) for a, b, _ in articles), (len(out), len(out))]:
            for x in out[at:a]:
                size = size + len(x) if x != " " else 0
                longest = max(longest, size)
            size, at = 0, b
        if len(own) >= longest:
            return own
    return text(out)


def kept(out: list[str], articles: list[tuple[int, int, bool]], told: list[tuple[int, int, str]]) -> list[str]:
    """out with nothing in place of what classes tell to leave out; of nested ones the outermost is looked at first.

    What lies outside the articles goes, where they have text. What holds all articles that have text stays. Else, and within an
    article, what is surely told, as comments, goes, and other parts go where they have no more than half of the text of the page or of the article.
    """
    if not told:
        return out
    sizes = list(accumulate((len(x.strip()) for x in out), initial=0))
    starts, ends = [a for a, _, _ in articles], [b for _, b, _ in articles]
    own = list(accumulate((sizes[b] - sizes[a] for a, b, _ in articles), initial=0))
    out, done = list(out), 0
    for a, b, kind in sorted(told, key=lambda x: (x[0], -x[1])):
        if a < done:
            continue
        inside = sizes[b] - sizes[a]
        first, last = bisect_left(starts, a), bisect_right(ends, b)
        around = bisect_right(starts, a) - 1
        if around >= 0 and ends[around] >= b and (articles[around][0], articles[around][1]) != (a, b):
            whole = sizes[ends[around]] - sizes[starts[around]]
            gone = kind == "sure" or 2 * inside <= whole
        elif own[-1]:
            held = own[last] - own[first] if last > first else 0
            gone = held < own[-1]
        else:
            gone = kind == "sure" or 2 * inside <= sizes[-1]
        if gone:
            out[a:b] = [""] * (b - a)
            done = b
    return out


def host(url: str = "url") -> Column:
    """The host of a URL in lower case, without user and port; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def section(url: str = "url") -> Column:
    """The first step of a URL's path where another follows; empty for none."""
    return F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def templates(pages: DataFrame, least_pages: int = 5, share: float = 0.2, html: str = "html", url: str = "url") -> DataFrame:
    """(host, section, template): hashes of the subtrees on at least least_pages pages and on that share of the pages of a host (section null) or of a section.

    A page counts a subtree once. A list is bounded: by the number of subtrees on a page over share.
    """
    small_batches(pages.sparkSession, 200)
    given = pages.select(host(url).alias("host"), section(url).alias("section"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for h, part, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen: set[int] = set()
                parse(page, seen=seen)
                counts.update((h, part, s) for s in seen)
                counts[h, part, -1] += 1  # the page itself
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], t) for i, t in enumerate(kinds)] + [pa.array(list(counts.values()), pa.int64())], names=["host", "section", "subtree", "n"])

    counted = written(given.mapInArrow(run, "host string, section string, subtree long, n long").groupBy("host", "section", "subtree").agg(F.sum("n").alias("n")), "subtrees")
    hosts = counted.groupBy("host", "subtree").agg(F.sum("n").alias("n")).withColumn("section", F.lit(None).cast("string"))
    counted = counted.unionByName(hosts)
    sizes = counted.where("subtree = -1").select(F.col("host").alias("of"), F.col("section").alias("of_section"), F.col("n").alias("pages"))
    own = (F.col("host") == F.col("of")) & F.col("section").eqNullSafe(F.col("of_section"))
    many = counted.where(f"subtree <> -1 AND n >= {least_pages}").join(sizes, own).where(F.col("n") >= F.col("pages") * share)
    return many.groupBy("host", "section").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, most_broadcast: int = 20_000, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep and text, for every page; null pages have empty text, and so have pages without any.

    Repeated rows count as so many pages of their host and give equal texts. An empty table gives no rows. Columns not in
    keep are left out, so none can clash; a column named text is replaced. Pages without host are those of one host.
    """
    found = written(templates(pages, html=html, url=url), "templates")
    small_batches(pages.sparkSession, 200)
    small = found.count() <= most_broadcast
    sided = lambda lists: F.broadcast(lists) if small else lists.hint("merge")
    of_host = found.where("section IS NULL").select(F.col("host").alias("__of"), F.col("template").alias("__t"))
    of_section = found.where("section IS NOT NULL").select(F.col("host").alias("__sof"), F.col("section").alias("__part"), F.col("template").alias("__s"))
    given = pages.select(*[f"`{c}`" for c in keep], F.coalesce(F.col(html), F.lit("")).alias("__html"), host(url).alias("__host"), section(url).alias("__section"))
    joined = given.join(sided(of_host), F.col("__host") == F.col("__of"), "left")
    joined = joined.join(sided(of_section), (F.col("__host") == F.col("__sof")) & (F.col("__section") == F.col("__part")), "left").select(*keep, "__html", "__t", "__s")
    rest = [c for c in keep if c != "text"]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in ("__html", "__t", "__s")]
            texts = [parse(p, {*(t or ()), *(s or ())}) for p, t, s in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(texts, pa.string())], names=[*rest, "text"])

    return joined.mapInArrow(run, schema)
