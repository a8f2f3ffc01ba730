"""Main text of web pages by equivalence classes of template tokens.

Tokens are start and end tags at their path of block elements, and whole blocks of text at theirs (a block is template or data;
text is never cut inside one). A token's occurrence vector is its number of occurrences on each page of its host. Tokens of one vector form
a class; classes of ``MIN_CLASS`` tokens on ``MIN_PAGES`` pages that keep one order on every page and always stand in one slot of
the class around them are valid, and nested they are the host's template. What the template's text does not fill are its slots.

Extraction reads each page against its host's template: the blocks inside the article (``article`` or ``main``) are kept, elsewhere
blocks that are template text (of a class on at least ``SHARE`` of the pages), stand in a slot that mostly holds links, or mostly are
links go. Elements that name themselves menus, footers, forms, notices, adverts, comments and so on go everywhere. Pages of a
host with few pages have no template and are read by their own tags.

At scale: a vector is never gathered. It is the exclusive or of one hash a page, so classes come from an aggregate that every task
starts, keyed by host and token: a host with a third of all pages is spread over its tokens. Tokens on less than a twentieth of a host's pages
are no candidates, so a host's template is bounded by twenty pages' worth of tokens. Hosts with more than a thousandth of
all pages (at most a thousand, broadcast) are salted before pages meet templates. Pages are parsed twice, their texts dealt once at most.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import BLOCK_ROWS, giving_back, table, written

MIN_CLASS = 3
MIN_PAGES = 3
CANDIDATE_PART = 20  # a candidate token is on one in so many pages of its host
SHARE = 0.5
HOT_PART = 1000  # a host with one in so many of all pages is salted

# The element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul noscript template title button iframe object svg canvas video audio label textarea script style""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
            "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDERS = frozenset("ul ol menu dl table select div article section aside nav td th".split())  # an implied end goes no further up
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CHROME_TAGS = frozenset("""nav footer aside form script style noscript template head iframe svg button select textarea dialog menu object
canvas video audio search""".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion
sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup
login menu menus nav navbar navigation breadcrumb breadcrumbs crumbs sidebar sidebars rail widget widgets footer masthead topbar toolbar share
sharing social comment comments commentlist replies respond disqus discussion feedback related recommended recommendations pagination
pager copyright disclaimer skip complementary contentinfo search""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""", re.S | re.X)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _hash(s: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Element:
    __slots__ = ("tag", "path", "chrome", "named", "main", "holds", "up")

    def __init__(self, tag, path, chrome, named, main, up):
        self.tag, self.path, self.chrome, self.named, self.main, self.up, self.holds = tag, path, chrome, named, main, up, False


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element, text, links):
        self.element, self.text, self.links = element, text, links


def _label(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """An element's name in paths, whether it is hidden, whether its class, id or role names a part around the article."""
    if not attrs.strip(" /\n\t"):
        return tag, False, False
    label, hidden, named = tag, False, False
    for m in NAMED.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in WORDS.findall(value)}
            named |= bool(words & CHROME_WORDS) or ("header" in words and not words & {"article", "post", "entry", "story", "content"})
            label += (".", "#", "@")[("class", "id", "role").index(name)] + re.sub(r"\d+", "0", value)
    return label, hidden, named


def parse(page: str):
    """``(tokens, blocks)`` of a page: tokens are (kind, path, block index or -1) in order; blocks have their element and text."""
    tokens, blocks, stack, elements = [], [], [], []
    root = Element("", "", False, False, False, None)
    text, links, in_a = [], 0, 0
    pos, n = 0, len(page)

    def top():
        return stack[-1] if stack else root

    def flush():
        nonlocal links
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if t:
                blocks.append(Block(top(), t, min(links, len(t))))
                tokens.append(("#", top().path, len(blocks) - 1))
        links = 0

    def add(s):
        nonlocal links
        text.append(s)
        if in_a:
            links += len(" ".join(s.split()))

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        m = TAG.match(page, lt)
        if m is None:  # a bare <
            add(page[pos:lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            add(page[pos:lt])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif tag not in BLOCK:
            if tag == "a":
                in_a = 0 if m["end"] else 1
            elif tag in RAW and not m["end"]:
                pos = _skip(page, pos, tag)
        elif m["end"]:
            k = len(stack) - 1
            while k >= 0 and stack[k].tag != tag:
                k -= 1
            if k >= 0:
                flush()
                tokens.append((">", stack[k].path, -1))
                del stack[k:]
                in_a = 0
        else:
            flush()
            in_a = 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in HOLDERS:
                        break
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in SIBLINGS[tag]:
                        del stack[k:]
                    elif stack[k].tag in HOLDERS:
                        break
            label, hidden, named = _label(tag, m["attrs"])
            up = top()
            inside = any(e.tag in ("article", "main") for e in stack)
            chrome = hidden or tag in CHROME_TAGS or (tag == "header" and not inside)
            main = tag == "main" or (tag == "article" and not named)
            e = Element(tag, f"{up.path}/{label}", chrome, named and tag not in ("html", "body", "main"), main, up)
            elements.append(e)
            tokens.append(("<", e.path, -1))
            if tag in RAW:
                pos = _skip(page, pos, tag)
                tokens.append((">", e.path, -1))
            elif tag not in VOID:
                stack.append(e)
    flush()
    _hold(elements)
    return tokens, blocks


def _skip(page: str, pos: int, tag: str) -> int:
    """The end of a raw element's content and its end tag."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
    return m.end() if m else len(page)


def _hold(elements: list[Element]) -> None:
    """An element around the page's heading or main part is no side part, whatever its class says."""
    marks = [e for e in elements if e.tag in ("main", "h1")] or [e for e in elements if e.main]
    for e in marks:
        up = e.up
        while up is not None and not up.holds:
            up.holds = True
            up = up.up


def _outside(element: Element) -> bool:
    """In an element around the article by its tag, or by its class, id or role."""
    e = element
    while e is not None:
        if e.chrome or (e.named and not e.holds):
            return True
        e = e.up
    return False


def _in(element: Element, tags) -> bool:
    e = element
    while e is not None:
        if e.main and e.tag in tags:
            return True
        e = e.up
    return False


def main_text(page: str, template: frozenset | set = frozenset(), menus: frozenset | set = frozenset()) -> str:
    """The article's blocks joined by newlines, given the host's template texts and slots of links (token hashes)."""
    _, blocks = parse(page)
    left = [b for b in blocks if not _outside(b.element)]
    for tags in (("article",), ("main",)):
        inner = [b for b in left if _in(b.element, tags)]
        if inner:
            return "\n".join(b.text for b in inner)
    out = []
    for b in left:
        if template and _hash(f"#{b.element.path}\0{b.text}") in template:
            continue
        if 2 * b.links > len(b.text) or (menus and _hash(f"~{b.element.path}") in menus):
            continue
        out.append(b.text)
    return "\n".join(out)


def page_tokens(page: str) -> tuple[list[int], list[dict], list[dict]]:
    """Token hashes in order; each distinct one with its occurrences, first place (from 1) and whether it is text; and every path
    with text, with its characters and how many of them are in links."""
    tokens, blocks = parse(page)
    out, texts = [], set()
    known: dict = {}
    slots: dict[str, list[int]] = {}
    for kind, path, b in tokens:
        if kind == "#":
            block = blocks[b]
            out.append(_hash(f"#{path}\0{block.text}"))
            texts.add(out[-1])
            s = slots.setdefault(path, [0, 0])
            s[0] += len(block.text)
            s[1] += block.links
        else:
            h = known.get((kind, path))
            if h is None:
                h = known[(kind, path)] = _hash(kind + path)
            out.append(h)
    at: dict[int, int] = {}
    for i, h in enumerate(out):
        at.setdefault(h, i + 1)
    counts = [{"token": h, "n": n, "at": at[h], "is_text": h in texts} for h, n in Counter(out).items()]
    return out, counts, [{"slot": _hash(f"~{p}"), "chars": c, "links": k} for p, (c, k) in slots.items()]


_PAGES = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64())),
                    ("counts", pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("is_text", pa.bool_())]))),
                    ("slots", pa.list_(pa.struct([("slot", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])))])
PAGES_DDL = ("host string, tokens array<long>, counts array<struct<token:long,n:int,at:int,is_text:boolean>>, "
             "slots array<struct<slot:long,chars:long,links:long>>")


def _tokenise(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(a, BLOCK_ROWS)
            made = [page_tokens(p or "") for p in some.column("html").to_pylist()]
            tokens, counts, slots = zip(*made)
            yield pa.RecordBatch.from_arrays([some.column("host"), *(pa.array(x, f.type) for x, f in zip((tokens, counts, slots), list(_PAGES)[1:]))],
                                             schema=_PAGES)


def in_order(places: list[list[int]]) -> list[bool]:
    """Which tokens of a class (by rank, each with its places on a page) keep the class's order there: a longest run of first
    places that ascends, and of it those whose later places interleave, too."""
    tails, at, back = [], [], []
    for r, p in enumerate(places):
        k = bisect_left(tails, p[0])
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(p[0])
            at.append(r)
        else:
            tails[k], at[k] = p[0], r
    good = [False] * len(places)
    r = at[-1] if at else -1
    while r >= 0:
        good[r] = True
        r = back[r]
    first = last = None
    for r, p in enumerate(places):
        if not good[r]:
            continue
        if first is None:
            first = p
        elif not (all(x < y for x, y in zip(last, p)) and all(x < y for x, y in zip(p, first[1:]))):
            good[r] = False
            continue
        last = p
    return good


def page_structure(tokens: list[int], classes: dict[int, tuple[int, int]], sizes: dict[int, int]):
    """``(class, token or None, slot)`` rows of a page: tokens out of order, and the slot around each class's first token.

    ``classes``: token to (class, rank); a slot is a hash of (class around it, its last token before), 0 at the top.
    """
    places: dict[int, dict[int, list[int]]] = {}
    for i, t in enumerate(tokens):
        c = classes.get(t)
        if c is not None:
            places.setdefault(c[0], {}).setdefault(c[1], []).append(i)
    token_of = {c: t for t, c in classes.items()}
    out = []
    for c, by_rank in places.items():
        ranks = sorted(by_rank)
        for r, ok in zip(ranks, in_order([by_rank[r] for r in ranks])):
            if not ok:
                out.append((c, token_of[(c, r)], None))
    open_, slots = [], {}
    for t in tokens:
        c = classes.get(t)
        if c is None:
            continue
        c, r = c
        if r == 0:
            around = next(((oc, rank) for oc, rank in reversed(open_) if oc != c), None)
            slots.setdefault(c, set()).add(_hash(f"{around[0]}:{around[1]}") if around else 0)
        open_ = [x for x in open_ if x[0] != c]
        if r < sizes[c] - 1:
            open_.append((c, r))
    out += [(c, None, s) for c, found in slots.items() for s in found]
    return out


_ROWS = pa.schema([("host", pa.string()), ("class", pa.int64()), ("token", pa.int64()), ("slot", pa.int64())])


def _structures(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(a, BLOCK_ROWS)
            rows = []
            for host, tokens, template in zip(*[some.column(c).to_pylist() for c in ("host", "tokens", "template")]):
                classes, sizes = {}, Counter()
                for t in template:
                    classes[t["token"]] = (t["class"], t["rank"])
                    sizes[t["class"]] += 1
                rows += [(host, *r) for r in page_structure(tokens, classes, sizes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def host_of(url) -> F.Column:
    """The host of a URL in lower case; null where there is none."""
    h = F.lower(F.regexp_extract(F.trim(F.coalesce(url.cast("string"), F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def _salts(hosts: DataFrame, total: int) -> DataFrame:
    """``host, parts`` of the hosts with more than one in ``HOT_PART`` of all pages: fewer than ``HOT_PART`` rows."""
    return hosts.where(F.col("pages") * HOT_PART > F.lit(total)).select(
        "host", F.ceil(F.col("pages") * HOT_PART / F.lit(max(1, total))).cast("int").alias("parts"))


def _meet(pages: DataFrame, by_host: DataFrame, hot: DataFrame, how: str, mark) -> DataFrame:
    """``pages`` joined with one row a host; hot hosts' pages are dealt over several copies of theirs. ``mark``: a hash of the page's row."""
    dealt = (pages.join(F.broadcast(hot.withColumnRenamed("host", "_hot")), F.col("_host") == F.col("_hot"), "left")
             .withColumn("_salt", F.pmod(mark, F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("_hot", "parts"))
    copies = (by_host.join(F.broadcast(hot), "host", "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
              .withColumnRenamed("host", "_of").withColumnRenamed("_salt", "_part"))
    return dealt.join(copies, (F.col("_host") == F.col("_of")) & (F.col("_salt") == F.col("_part")), how).drop("_of", "_part", "_salt")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_class: int = MIN_CLASS, min_pages: int = MIN_PAGES,
              share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """``(host, texts, menus)`` - hashes of each host's template texts and slots of links - and the hot hosts with their salts.

    Pages of one host with the same tokens count once.
    """
    slim = written(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("host IS NOT NULL")
                   .mapInArrow(giving_back(_tokenise), PAGES_DDL).withColumn("page", F.xxhash64("tokens"))
                   .dropDuplicates(["host", "page"]), "template-pages")
    hosts = written(slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "template-hosts")
    hot = written(_salts(hosts, slim.count()), "template-hot")
    # occurrence vectors: one hash a page, combined by exclusive or; the sum of first places orders a class
    per = slim.select("host", "page", F.explode("counts").alias("_t")).select("host", "page", "_t.*")
    vectors = per.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("v1"), F.sum("at").alias("at"), F.max("is_text").alias("is_text"))
    candidates = (vectors.where(F.col("on") >= min_pages).join(hosts, "host")
                  .where(F.col("on") * CANDIDATE_PART >= F.col("pages"))
                  .select("host", "token", F.xxhash64("v1", "on").alias("class"), "at", "is_text", (F.col("on") >= F.col("pages") * share).alias("common")))
    one = F.struct("at", "token", "is_text", "common")
    classes = (candidates.groupBy("host", "class").agg(F.sort_array(F.collect_list(one)).alias("tokens"))
               .where(F.size("tokens") >= min_class)
               .select("host", F.posexplode("tokens").alias("rank", "_t"), "class")
               .select("host", "class", "rank", "_t.token", "_t.is_text", "_t.common"))
    classes = written(classes, "template-classes")
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "rank")).alias("template"))
    seen = _meet(slim.select(F.col("host").alias("_host"), "tokens", "page"), by_host, hot, "inner", F.col("page"))
    rows = (seen.select(F.col("_host").alias("host"), "tokens", "template")
            .mapInArrow(giving_back(_structures), "host string, class long, token long, slot long"))
    rows = written(rows.groupBy("host", "class", "token").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")), "template-structure")
    moved = rows.where("token IS NULL AND lo <> hi").select("host", "class")  # not nested in one slot
    disordered = rows.where("token IS NOT NULL").select("host", "class", "token")
    valid = classes.join(moved, ["host", "class"], "left_anti").join(disordered, ["host", "class", "token"], "left_anti")
    whole = valid.groupBy("host", "class").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_class).select("host", "class")
    texts = (valid.where("is_text AND common").join(whole, ["host", "class"], "left_semi")
             .groupBy("host").agg(F.collect_list("token").alias("texts")))
    menus = (slim.select("host", F.explode("slots").alias("s")).groupBy("host", "s.slot")
             .agg(F.count(F.lit(1)).alias("on"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links")).where(F.col("on") >= min_pages)
             .join(hosts, "host").where((F.col("on") * CANDIDATE_PART >= F.col("pages")) & (F.col("links") * 2 > F.col("chars")))
             .groupBy("host").agg(F.collect_list("slot").alias("menus")))
    return written(texts.join(menus, "host", "full").select("host", "texts", "menus"), "template-texts"), hot


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html", **deduce) -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars`` (its code points) beside its columns.

    Null html is empty; a page without a host in its URL is read without a template. Columns of ``pages`` named ``text`` or
    ``n_chars`` are replaced.
    """
    found, hot = templates(pages, url_col, html_col, **deduce)
    pages = pages.drop("text", "n_chars")
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    packed = pages.select(own.alias("_row"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    joined = _meet(packed, found, hot, "left", F.xxhash64("_html"))

    def extract(html: pd.Series, texts: pd.Series, menus: pd.Series) -> pd.Series:
        def as_set(x):
            return frozenset() if x is None else frozenset(x.tolist())
        return pd.Series([main_text(h or "", as_set(t), as_set(m)) for h, t, m in zip(html, texts, menus)], dtype=object)

    text = F.pandas_udf(extract, "string")(F.col("_html"), F.col("texts"), F.col("menus"))
    out = joined.select("_row", text.alias("text"))
    return out.select("_row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op12_html_extraction(spark, sf_dir) -> DataFrame:
    """Contract query: the main text of every page."""
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
