"""Main text of web pages by equivalence-class template deduction.

Every page is parsed once into tag tokens (the paths of its elements) and text
blocks. Tokens of one host that occur equally often on every page have one
occurrence vector and form an equivalence class; a class of two tokens or more
on at least `share` of the host's different pages is valid. Valid classes nest
by the elements that their tags lie in, which gives the host's template. A text
token is a path with its text; it can be in its path's class only if all of the
path's blocks on a page say the same, so only such texts are counted.

What the template's texts leave open are its slots. The host's core is the
deepest template element, once a page, whose slots hold `most` of the running
text that varies on the host's pages; text in links and in elements for menus,
footers, sidebars and forms weighs nothing, text under names such as `ad` or
`comments` a twentieth, marked articles fourfold. The main text lies in the
region around the core: its article, or the widest element around it that adds
only headings and plain lines. Within the region a text that repeats on other
pages (a byline, a heading) stays; outside it, and before or behind all varying
text where the region is the whole body, it is furniture. Names take effect
inside a region only beside the core: names on the core or around it, or those
that would leave a page less than a twentieth of its text, are ignored.

Counting is by (host, token), so neither pages nor hosts are gathered. Copies
of one page count once in classes. Null html gives an empty text; a null or
malformed url is a host of its own name; repeated rows give repeated results.
A host with fewer than `least_pages` different pages has no template, its pages
find the core by their own text. Parsing is linear in a page's length: a tag
without an end swallows the rest.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waymesh.session import materialise

#: Elements whose whole content is no text.
_RAW = frozenset("script style noscript template textarea svg math iframe object select canvas audio video title".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_TAG = re.compile(r"[a-zA-Z][\w:-]*")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
# The elements of HTML by what they mean here.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
_NAME = re.compile(
    r"(?<!with)(?<!has)(?<!no)(?<!without)(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widgets?|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|pagination|pager|tags?|tagcloud|copyright|legal|disclaimer|skip|hidden)(?:$|[-_\s])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[-_\s])headers?(?:$|[-_\s])", re.I)
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu", re.I)
_ATTR = re.compile(r"(?<![\w:-])([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DIGITS = re.compile(r"\d+")
_CLOSES_P = _BLOCK - {"body", "html"}
# What an element's start closes where the element itself was left open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P = {"p"}
_SCOPE = frozenset("ul ol dl table article section main div aside nav header footer form body html blockquote".split())


def _attributes(raw: str, article: bool) -> tuple[str, bool, bool]:
    """(class and id of a tag, whether they name chrome, whether other attributes hide it or give it such a role); an article's own header may be part of it."""
    if "=" not in raw and "hidden" not in raw.lower():
        return "", False, False
    got = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(raw)}
    name = " ".join(got[k] for k in ("class", "id") if k in got)
    style = got.get("style", "").replace(" ", "").lower()
    named = bool(name and (_NAME.search(name) or not article and _HEADER.search(name)))
    off = bool(_ROLE.fullmatch(got.get("role", ""))) or got.get("aria-hidden") == "true" or "display:none" in style or "hidden" in _ATTR.sub("", raw).lower().split()
    return _DIGITS.sub("#", name), named, off


def _tag_end(page: str, at: int) -> int:
    """Where a tag that is open at `at` ends (behind its >), quoted values skipped; -1 if nowhere."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        at = m.end()
        if m.group() == ">":
            return at
        q = _QUOTE.match(page, at)
        if q:
            end = page.find(q.group(1), q.end())
            at = end + 1 if end >= 0 else q.end()
            if end < 0 and page.find(">", at) < 0:
                return -1


class Block(NamedTuple):
    """A text block: its path, text, characters outside links, whether in chrome, in an article, a title, and the name-marked elements around it."""

    path: int
    text: str
    prose: int
    chrome: bool
    article: bool
    title: bool
    named: tuple[int, ...]


def _hash(s: str) -> int:
    return xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(page: str | None) -> tuple[list[Block], dict[int, list[int]]]:
    """Text blocks in page order, and by element path [path around it, occurrences, kind, depth]; kind: 1 article or main, 2 chrome, 3 html or body, else 0."""
    page = page or ""
    # tag, path, chrome (1: a form, which may wrap a whole page, 2: anything else), article, named
    stack: list[tuple[str, int, int, bool, tuple[int, ...]]] = [("", 0, 0, False, ())]
    out, text, where, tags, prose = [], [], None, {}, 0
    at, size = 0, len(page)
    # places on the stack: of each name, of blocks, of elements that shield what is open outside them
    places: dict[str, list[int]] = {}
    block_at, scopes = [0], [0]

    def cut(i: int) -> None:
        """Close the element at place i and all within it."""
        while len(stack) > i:
            name = stack.pop()[0]
            places[name].pop()
            if block_at[-1] == len(stack):
                block_at.pop()
            if scopes[-1] == len(stack):
                scopes.pop()

    def flush() -> None:
        nonlocal where, prose
        if text:
            s = "".join(text)
            s = " ".join((_html.unescape(s) if "&" in s else s).split())
            if s:
                tag, path, chrome, article, named = where
                out.append(Block(path, s, min(prose, len(s)), chrome > 0, article, tag == "h1", named))
            text.clear()
        where, prose = None, 0

    def put(s: str) -> None:
        nonlocal where, prose
        if s:
            if where is None and not s.isspace():
                where = stack[block_at[-1]][:2] + stack[-1][2:]
            if not places.get("a"):
                prose += len(s)
            text.append(s)

    def close(names: set[str]) -> None:
        """Close the innermost open element of these names, unless a shielding one lies in it."""
        i = max(places[n][-1] if places.get(n) else 0 for n in names)
        if i > scopes[-1]:
            cut(i)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            put(" ")
            at = end + 3 if end >= 0 else size
            continue
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        end_tag = nxt == "/"
        m = _TAG.match(page, lt + 1 + end_tag)
        if m is None:  # no tag: a bare sign, or an end tag without a name
            if end_tag:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                put("<")
                at = lt + 1
            continue
        tag, at = m.group().lower(), _tag_end(page, m.end())
        if at < 0:
            break
        raw = page[m.end() : at - 1]
        if tag in ("br", "wbr"):
            put(" " if tag == "br" else "")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if end_tag:
            # an inline end tag doesn't close the block around it
            if places.get(tag) and (block or places[tag][-1] > block_at[-1]):
                cut(places[tag][-1])
            continue
        if tag in _RAW and not raw.endswith("/"):
            m = _RAW_END[tag].search(page, at)
            if m is None:
                break
            at = _tag_end(page, m.end())
            if at < 0:
                break
            continue
        if tag in _VOID or tag in _RAW:
            continue
        if block:
            if stack[-1][0] == "head":
                cut(len(stack) - 1)  # a head may be left open
            if tag in _CLOSES_P:
                close(_P)  # an open paragraph ends here, with what is open inside
            if tag in _CLOSES:
                close(_CLOSES[tag])
        _, path, chrome, article, named = stack[-1]
        name, marked, off = _attributes(raw, article) if raw else ("", False, False)
        page_tag, main = tag in ("html", "body"), tag in ("article", "main")
        if main and chrome == 1:
            chrome = 0
        if off and not page_tag and not main or tag in _CHROME and tag != "form" and not (tag == "header" and article) or tag == "head":
            chrome = 2
        elif tag == "form" and (article or not chrome):
            chrome = max(chrome, 2 if article else 1)
        own = path
        if block:
            own = _hash(f"{path}/{tag}.{name}")
            kind = 3 if page_tag else 2 if chrome == 2 else int(main)
            tags.setdefault(own, [path, 0, kind, len(block_at)])[1] += 1
            if len(stack) > 200:  # deeper elements share a path
                own = path
        elif marked:
            own = _hash(f"{path}/{tag}.{name}")  # an inline element's name marks its text without a path of its own
        if marked and not page_tag and not main and own not in named and len(named) < 200:
            named = (*named, own)
        places.setdefault(tag, []).append(len(stack))
        if block:
            block_at.append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, own if block else path, chrome, (article or main) and not chrome, named))
    flush()
    return out, tags


def blocks(page: str | None) -> list[Block]:
    """The text blocks of parse()."""
    return parse(page)[0]


def _token(path: int, text: str) -> int:
    """A signed 64-bit hash of a text token."""
    return _hash(f"{path}\0{text}")


def host(url: Column) -> Column:
    """The host of a url in lower case, or the url itself, or an empty string."""
    got = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(got != "", got).otherwise(F.lower(F.coalesce(url, F.lit(""))))


PARSED = (
    "tags array<struct<path:bigint,parent:bigint,n:int,kind:int,depth:int>>, "
    "blocks array<struct<path:bigint,token:bigint,n:int,prose:int,chrome:boolean,article:boolean,title:boolean,named:array<bigint>,text:string>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, tags, blocks) of every row; page: a hash of its html. A block's token is null unless all blocks of its path on the page say the same."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tags, found = [], []
            for page in b:
                got, paths = parse(page)
                texts: dict[int, list[str]] = {}
                for x in got:
                    texts.setdefault(x.path, []).append(x.text)
                same = {p: _token(p, ss[0]) if len(set(ss)) == 1 else None for p, ss in texts.items()}
                tags.append([{"path": p, "parent": q, "n": n, "kind": k, "depth": d} for p, (q, n, k, d) in paths.items()])
                found.append([{"path": x.path, "token": same[x.path], "n": len(texts[x.path]), "prose": x.prose, "chrome": x.chrome, "article": x.article, "title": x.title, "named": x.named, "text": x.text} for x in got])
            yield pd.DataFrame({"tags": tags, "blocks": found})

    keyed = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("page"), run("html").alias("p"))
    return keyed.select("page_id", "url", "host", "page", "p.tags", "p.blocks")


def classes(parsed_pages: DataFrame, least_pages: int = 3, share: float = 0.5) -> DataFrame:
    """(host, class, path, token, parent, n, depth): the tokens of every valid class of each host; token is null for a tag, parent the path that a tag lies in, n the most often that a page has it.

    Copies of a page count once, and a vector is a sum over different pages.
    """
    tags = parsed_pages.select("host", "page", F.explode("tags").alias("t")).select("host", "page", "t.path", F.lit(None).cast("long").alias("token"), "t.n", "t.parent", "t.depth")
    said = parsed_pages.select("host", "page", F.explode("blocks").alias("b")).where("b.token is not null").select("host", "page", "b.path", "b.token", "b.n", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("depth"))
    once = tags.union(said).groupBy("host", "path", "token", "page").agg(F.max("n").alias("n"), F.min("parent").alias("parent"), F.max("depth").alias("depth"))
    # two independent sums of 64 bits stand for the vector
    mark = lambda k: F.sum(F.shiftright(F.xxhash64(F.lit(k), "page", "n"), 20)).alias(f"v{k}")
    per = once.groupBy("host", "path", "token").agg(mark(1), mark(2), F.count("*").alias("pages"), F.min("parent").alias("parent"), F.max("n").alias("n"), F.max("depth").alias("depth"))
    total = parsed_pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))
    valid = per.join(total, "host").where((F.col("all_pages") >= least_pages) & (F.col("pages") >= share * F.col("all_pages")) & (F.col("pages") >= least_pages))
    # a path's texts join the class of its tag alone: a text that comes and goes with other tags is content
    tag = valid.where("token is null").select("host", "path", "v1", "v2")
    kept = valid.where("token is null").unionByName(valid.where("token is not null").join(tag, ["host", "path", "v1", "v2"], "left_semi").select(valid.columns))
    named = kept.withColumn("class", F.xxhash64("v1", "v2")).select("host", "class", "path", "token", "parent", "n", "depth")
    several = named.groupBy("host", "class").agg(F.count("*").alias("c")).where("c > 1").select("host", "class")
    return named.join(several, ["host", "class"], "left_semi")


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.5) -> DataFrame:
    """(host, class, within, tags, texts): each host's template as nested classes.

    within: the class that holds the element around the class's outermost tag,
    null at the top; tags and texts: hashes of its tokens.
    """
    return nested(materialise(classes(parsed(pages), least_pages, share), "classes"))


def nested(found: DataFrame) -> DataFrame:
    """templates() of the table that classes() gives."""
    tags = found.where("token is null")
    own = tags.select("host", F.col("path").alias("parent"), F.col("class").alias("within"))
    up = tags.join(own, ["host", "parent"], "left").where("within is null or within <> class").groupBy("host", "class").agg(F.min("within").alias("within"))
    out = found.groupBy("host", "class").agg(F.array_sort(F.collect_set(F.when(F.col("token").isNull(), F.col("path")))).alias("tags"), F.array_sort(F.collect_set("token")).alias("texts"))
    return out.join(up, ["host", "class"], "left").select("host", "class", "within", "tags", "texts")


def _around(path: int, up: dict[int, int]) -> list[int]:
    """A path and those around it, inner ones first."""
    got = []
    while path and path in up:
        got.append(path)
        path = up[path]
    return got


def weights(tags, blocks, single, fixed) -> dict[int, int]:
    """By path: the weight of a page's varying text in it, for the paths of single; path 0 is the page."""
    up = {t["path"]: t["parent"] for t in tags}
    own: dict[int, int] = {}
    for b in blocks:
        if b["prose"] and not b["chrome"] and b["token"] not in fixed:
            own[b["path"]] = own.get(b["path"], 0) + b["prose"] * (1 if len(b["named"]) else 80 if b["article"] else 20)
    for t in sorted(tags, key=lambda t: -t["depth"]):
        w = own.get(t["path"], 0)
        if w and t["parent"] != t["path"]:
            own[t["parent"]] = own.get(t["parent"], 0) + w
    return {p: w for p, w in own.items() if p == 0 or p in single and p in up}


def chosen(tags, blocks, single, fixed, core, most: float) -> list[int]:
    """Places of the blocks that are main text; core: the host's, or None."""
    up, kind = {t["path"]: t["parent"] for t in tags}, {t["path"]: t["kind"] for t in tags}
    if core is None or core not in up or not weights(tags, blocks, {core}, fixed).get(core):
        depth = {t["path"]: t["depth"] for t in tags}
        for seen in (fixed, frozenset()):  # by the page's own text, where all of it is the template's by any text
            got = weights(tags, blocks, {t["path"] for t in tags if t["n"] == 1 and t["kind"] != 2}, seen)
            inner = [p for p, w in got.items() if p and w >= most * got[0]]
            if got.get(0):
                fixed = seen
                break
        core = max(inner, key=lambda p: depth[p], default=0) if got.get(0) else 0
    line = _around(core, up)
    path_line: dict[int, frozenset[int]] = {}
    for b in blocks:
        if b["path"] not in path_line:
            path_line[b["path"]] = frozenset(_around(b["path"], up))
    within = lambda b, p: not p or p in path_line[b["path"]]
    varies = [b["token"] not in fixed for b in blocks]

    # names on the core's line, or the names that would take nearly all of the page's text, mark nothing
    void, plain, taken = set(line), 0, {}
    for b, v in zip(blocks, varies):
        if v and not b["chrome"]:
            left = tuple(x for x in b["named"] if x not in void)
            if left:
                taken[left] = taken.get(left, 0) + b["prose"]
            else:
                plain += b["prose"]
    if taken:
        names, n = max(taken.items(), key=lambda x: (x[1], x[0]))
        if plain * 20 < n:
            void |= set(names)
    fits = [not b["chrome"] and all(x in void for x in b["named"]) for b in blocks]

    # the region: the outermost article around the core, or what only adds titles and plain lines
    region = next((p for p in reversed(line) if kind[p] == 1), None)
    if region is None:
        region = core
        for p in line[1:]:
            if kind[p] == 3:
                break
            added = [i for i, b in enumerate(blocks) if within(b, p) and not within(b, region)]
            had = sum(b["prose"] for b, f in zip(blocks, fits) if f and within(b, region))
            if not all(fits[i] and 2 * blocks[i]["prose"] >= blocks[i]["size"] for i in added) or 5 * sum(blocks[i]["prose"] for i in added if not blocks[i]["title"]) > had:
                break
            region = p
    inside = [i for i, b in enumerate(blocks) if fits[i] and within(b, region)]
    in_article = sum(blocks[i]["prose"] for i in inside if blocks[i]["article"])
    if 2 * in_article >= sum(blocks[i]["prose"] for i in inside) and in_article:
        return [i for i in inside if blocks[i]["article"]]
    if not region or kind[region] == 3:  # the whole body: furniture before and behind all varying text goes
        running = [i for i in inside if varies[i] and 2 * blocks[i]["prose"] >= blocks[i]["size"]]
        return [i for i in inside if running and running[0] <= i <= running[-1]] if running else inside
    # a title that stands outside its text
    if inside and not any(blocks[i]["title"] for i in inside):
        titles = [i for i, b in enumerate(blocks) if i < inside[0] and fits[i] and varies[i] and b["title"]]
        return titles[-1:] + inside
    return inside


def main_text(pages: DataFrame, least_pages: int = 3, share: float = 0.5, broadcast_bytes: int = 16_000_000, most: float = 0.6) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    seen = materialise(parsed(pages), "pages")
    found = materialise(classes(seen, least_pages, share), "classes")
    known = found.groupBy("host").agg(F.collect_set("token").alias("fixed"), F.collect_set(F.when(F.col("token").isNull() & (F.col("n") == 1), F.col("path"))).alias("single"))
    known = materialise(known, "templates")

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        size = right.agg(F.coalesce(F.sum(F.size("fixed") * 8 + F.size("single") * 8 + F.length("host") + 48), F.lit(0)).alias("n")).first()["n"]
        return left.join(F.broadcast(right) if size <= broadcast_bytes else right, "host", "left")

    # texts stay in the JVM: their lengths are all that choosing needs; a null token is 0, as null would make them doubles
    slim = F.transform("blocks", lambda b: F.struct(b["path"], F.coalesce(b["token"], F.lit(0)).alias("token"), b["prose"], F.length(b["text"]).alias("size"), b["chrome"], b["article"], b["title"], b["named"]))
    bare = seen.withColumn("bare", slim)

    @F.pandas_udf("array<struct<path:bigint,weight:bigint>>")
    def weigh(tags: pd.Series, bs: pd.Series, single: pd.Series, fixed: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "weight": w} for p, w in weights(t, b, set(s), set(f)).items()] for t, b, s, f in zip(tags, bs, single, fixed)])

    per = beside(bare, known).where("fixed is not null").select("host", F.explode(weigh("tags", "bare", "single", "fixed")).alias("w"))
    per = per.groupBy("host", F.col("w.path").alias("path")).agg(F.sum("w.weight").alias("weight"))
    depth = found.where("token is null").groupBy("host", "path").agg(F.max("depth").alias("depth"))
    total = per.where("path = 0").select("host", F.col("weight").alias("all"))
    inner = per.where("path <> 0").join(total, "host").where(F.col("weight") >= most * F.col("all")).join(depth, ["host", "path"])
    cores = inner.groupBy("host").agg(F.max_by("path", F.struct("depth", "path")).alias("core"))
    template = materialise(known.join(cores, "host", "left"), "cores")

    @F.pandas_udf("array<int>")
    def choose(tags: pd.Series, bs: pd.Series, single: pd.Series, fixed: pd.Series, core: pd.Series) -> pd.Series:
        empty = frozenset()
        return pd.Series([chosen(t, b, empty if s is None else set(s), empty if f is None else set(f), None if pd.isna(c) else int(c), most) for t, b, s, f, c in zip(tags, bs, single, fixed, core.astype("object"))])

    out = beside(bare, template).withColumn("core", F.col("core").cast("string"))
    out = out.select("page_id", "url", "blocks", choose("tags", "bare", "single", "fixed", "core").alias("places"))
    text = F.array_join(F.transform("places", lambda i: F.get("blocks", i)["text"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
