"""Operator 7: main text of web pages by template deduction per host.

Every distinct page of a host becomes tokens: its elements by their path (tag,
class, id, role, with digits unified) and all its texts. A token's occurrence
vector over the pages is kept as an additive digest (pages, occurrences, sum of
hashes of (page, count)), so vectors of any length are compared without
gathering them. Tokens of one host with equal vectors form an equivalence
class; a class is valid when it holds an element and spans MIN_PAGES pages or
more. The class of the tokens that occur once on every page is the template's
root; the others nest below the deepest root element on their path. The texts
of the root and of nested classes made of elements and their own texts are
constant. A region of a page (a container and what it holds) is the template's
if every text in it is constant; a region with an open slot says something of
its own, and there a constant text is content that merely repeats (a heading
such as "Introduction"). Template regions are taken out everywhere, articles
included. Of the remaining regions, an article or main element is the content,
else all that are no navigation, header, footer, side bar, notice, advert, form
or comment: slots that are open on every page but not the author's are told by
their elements; a form or class word above the article is a wrapper.

Markup is read in time linear in its length: long paths go on from a digest of
their upper part, and elements nested more than DEEPEST deep are read as
siblings at that depth, as browsers do.

Blocks are joined by an empty line; white space inside a block is one space;
character references are decoded. Nothing is dropped or capped by length.

Defined results: null or empty html has the text '' and 0 characters; a null
url belongs to the host ''; hosts with fewer than MIN_PAGES distinct pages have no
template and are read by their elements alone; rows map one to one; copies of
a page count as one page; extra columns are ignored.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare, written

MIN_PAGES = 3
#: nesting that is kept apart, and characters of a path before its upper part is digested
DEEPEST, LONGEST_PATH = 256, 400

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                  "header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option optgroup".split())
UNSHOWN = frozenset("select button svg canvas audio video object math datalist".split())
BOILERPLATE = frozenset("head nav footer aside menu dialog search".split())
#: with the class words, boilerplate that may also wrap a whole page
SOFT = frozenset("form fieldset".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs "
                  "comment comments disqus reply replies cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe "
                  "signup login search pagination pager toolbar widget contentinfo complementary skip".split())
ARTICLE = frozenset("article main".split())
#: elements whose texts belong to the region around them
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot blockquote pre figcaption caption center hgroup summary address".split())
ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HARD = ("!",)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Comments and declarations; raw elements with what they hold; tags; tags with unpaired quotes.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
                   rf"|<((?i:{'|'.join(sorted(RAW))}))\b[^>]*+>.*?(?:</(?i:\1)[^>]*+>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_DIGITS = re.compile(r"[0-9]+")


@dataclass
class Element:
    tag: str
    path: str
    chain: tuple[str, ...] = ()  # boilerplate elements up to the innermost article or the body; HARD below one that wraps nothing
    above: tuple[str, ...] = ()  # those outside of the article
    article: str = ""  # path of the innermost article
    unshown: bool = False
    inline: bool = False


@dataclass
class Page:
    """Element paths in order, and blocks (path, text, chain, above, article, region) as in Element.

    ``region`` numbers the container that a block stands in; ``within`` gives each region the one around it. 0 is
    what surrounds everything; an article or main element starts a region that stands in 0.
    """
    paths: list[str] = field(default_factory=list)
    blocks: list[tuple[str, str, tuple[str, ...], tuple[str, ...], str, int]] = field(default_factory=list)
    within: list[int] = field(default_factory=lambda: [0])


def _label(tag: str, attributes: str) -> tuple[str, set[str]]:
    """Path label of an element and the words of its class, id and role."""
    names, seen = [], set()
    if attributes:
        for kind, a, b, c in _ATTRIBUTE.findall(attributes):
            value = entities.unescape(a or b or c)
            names.append(f"{kind.lower()}={_DIGITS.sub('0', value.strip())}")
            seen.update(_SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()))
    return tag + "".join(f"[{n}]" for n in sorted(names)), seen


_CHILDREN: dict[tuple, Element] = {}


def child(top: Element, tag: str, attributes: str) -> Element:
    """The element opened below ``top``; remembered, as pages repeat their structure."""
    key = (top.path, top.chain, top.above, top.article, top.unshown, tag, attributes)
    found = _CHILDREN.get(key)
    if found is None:
        label, named = _label(tag, attributes)
        path = f"{top.path if len(top.path) <= LONGEST_PATH else '#' + xxhash.xxh3_64_hexdigest(top.path.encode())}/{label}"
        chain, above, article = top.chain, top.above, top.article
        if tag == "body":  # also where the head was left open
            chain = ()
        elif tag in ARTICLE or "role=main" in label:
            chain, above, article = (), above + chain, path
        elif tag in BOILERPLATE or tag == "header" and not article:
            chain = HARD
        elif chain != HARD and (tag in SOFT or tag != "html" and not named.isdisjoint(WORDS)):
            chain = (*chain, path)
        if len(_CHILDREN) > 20_000:
            _CHILDREN.clear()
        found = _CHILDREN[key] = Element(tag, path, chain, above, article, top.unshown)
    return found


def parse(html: str) -> Page:
    """A forgiving reading of the markup: broken, unclosed and crossed tags included."""
    page, stack, regions = Page(), [Element("", "")], [0]  # regions[i]: the region inside stack[i]
    paths, blocks, within = page.paths, page.blocks, page.within
    open_: Counter = Counter()  # open elements by name
    text: list[str] = []
    end = html.rfind(">") + 1  # no tag ends beyond it
    parts = _MARK.split(html[:end])
    parts[-1] += html[end:]

    def flush() -> None:
        if text:
            own = "".join(text)
            own = " ".join((entities.unescape(own) if "&" in own else own).split())
            if own:
                top = stack[-1]
                blocks.append((top.path, own, top.chain, top.above, top.article, regions[-1]))
            text.clear()

    def leave(k: int) -> None:
        """Close the elements from stack[k] on."""
        for gone in stack[k:]:
            open_[gone.tag] -= 1
        del stack[k:], regions[k:]

    def enter(element: Element, region: int) -> None:
        stack.append(element)
        regions.append(region)
        open_[element.tag] += 1

    # parts: text, then for each mark its 7 groups and the text behind it
    for i in range(0, len(parts), 8):
        if i:
            raw, closing, tag, attributes = parts[i - 7], parts[i - 6], parts[i - 5], parts[i - 4]
            if tag is None:
                closing, tag, attributes = parts[i - 3], parts[i - 2], parts[i - 1]
            if raw is not None:
                if raw.lower() != "title":
                    paths.append(f"{stack[-1].path}/{raw.lower()}")
            elif tag is not None:
                tag = tag.lower()
                if tag == "br":
                    text.append("\n")
                elif tag == "hr":
                    flush()
                elif tag in BLOCK:
                    if closing:
                        if open_[tag]:
                            k = len(stack) - 1
                            while stack[k].tag != tag:
                                k -= 1
                            flush()
                            leave(k)
                    else:
                        while stack[-1].inline:
                            leave(len(stack) - 1)
                        flush()
                        top = stack[-1].tag
                        if top == "p" or top in ALONE.get(tag, ()) or tag in HEADINGS and top in HEADINGS:
                            leave(len(stack) - 1)
                            if tag == "tr" and stack[-1].tag == "tr":
                                leave(len(stack) - 1)
                        leave(DEEPEST)
                        element = child(stack[-1], tag, attributes)
                        region = regions[-1]
                        if tag not in FLOW and tag not in ("html", "body"):
                            within.append(0 if element.article == element.path else region)
                            region = len(within) - 1
                        enter(element, region)
                        paths.append(element.path)
                elif tag in UNSHOWN:
                    if not closing:
                        if not attributes.endswith("/"):
                            leave(DEEPEST)
                            top = stack[-1]
                            enter(Element(tag, top.path, top.chain, top.above, top.article, True, True), regions[-1])
                    elif open_[tag]:
                        k = len(stack) - 1
                        while stack[k].inline and stack[k].tag != tag:
                            k -= 1
                        if stack[k].inline:
                            leave(k)
        said = parts[i]
        if said and not stack[-1].unshown:
            text.append(said)
    flush()
    return page


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return host


def constant_token(path: str, text: str) -> str:
    return f"{path}={xxhash.xxh3_64_hexdigest(text.encode())}"


def tokens_of(page: Page) -> Counter:
    """Tokens with their counts: all elements and all texts."""
    out = Counter(page.paths)
    out.update(constant_token(b[0], b[1]) for b in page.blocks)
    return out


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, key, html): each distinct page of a host once; only rows that have copies are shuffled with their html."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("key"), "html")
    copied = written(rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    one = rows.join(copied, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
    return rows.join(copied, ["host", "key"], "left_anti").unionByName(one)


def classes(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_occ, digest, token): tokens by host with the digest of their occurrence vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, key, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = tokens_of(parse(html)) if html else Counter()
                counts[""] = 1  # the page itself
                for token, n in counts.items():
                    own = seen.setdefault((host, token), [0, 0, 0])
                    own[0] += 1
                    own[1] += n
                    own[2] += xxhash.xxh3_64_intdigest(f"{key}:{n}".encode()) >> 24
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                 *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))], names=["host", "token", "n_pages", "n_occ", "digest"])

    part = distinct_pages(pages).mapInArrow(run, "host string, token string, n_pages bigint, n_occ bigint, digest bigint")
    return part.groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), F.sum("n_occ").alias("n_occ"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest"))


def templates(pages: DataFrame) -> DataFrame:
    """Valid classes: (host, token, root, class_no, parent, constant).

    ``root`` tokens occur once on every page of the host; the others nest in
    ``parent``, the deepest root element on their path. ``constant`` texts are
    the template's: those of the root, and those of a nested class in which
    every text's own element is of the class too. A class with other texts is
    that of pages alike in what they say.
    """
    found = written(classes(pages))
    every = found.where("token = ''").select("host", F.col("n_pages").alias("host_pages"), F.col("digest").alias("host_digest"))
    own = found.where("token <> ''").join(every, "host").where(F.col("n_pages") >= MIN_PAGES)
    root = (F.col("n_pages") == F.col("host_pages")) & (F.col("n_occ") == F.col("host_pages")) & (F.col("digest") == F.col("host_digest"))
    own = own.withColumn("root", root).withColumn("class_no", F.xxhash64("n_pages", "n_occ", "digest"))
    # A class of texts only, without an element, is no template but a repeated text, unless it belongs to the root.
    element = ~F.col("token").contains("=") | ~F.regexp_like("token", F.lit("=[0-9a-f]{16}$"))
    valid = own.groupBy("host", "class_no").agg(F.max(element).alias("valid")).where("valid").drop("valid")
    own = written(own.join(valid, ["host", "class_no"]).select("host", "token", "root", "class_no", element.alias("element")))
    # Every ancestor path of a token, matched with the root's elements: the longest is the parent.
    parts = F.split("token", "/")
    above = own.select("host", "token", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"), parts.alias("p"))
    above = above.select("host", "token", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("parent"))
    roots = own.where("root and element").select("host", F.col("token").alias("parent"))
    parent = above.join(roots, ["host", "parent"]).groupBy("host", "token").agg(F.max(F.struct(F.length("parent"), "parent")).alias("m")).select("host", "token", "m.parent")
    out = own.join(parent, ["host", "token"], "left")
    elements = own.where("element").select("host", "class_no", F.col("token").alias("path"))
    texts = own.where("not element").withColumn("path", F.regexp_replace("token", "=[0-9a-f]{16}$", ""))
    stray = texts.join(elements, ["host", "class_no", "path"], "left_anti").select("host", "class_no").distinct().withColumn("stray", F.lit(True))
    constant = ~F.col("element") & (F.col("root") | F.col("stray").isNull() & F.col("parent").isNotNull())
    return out.join(stray, ["host", "class_no"], "left").select("host", "token", "root", "class_no", "parent", constant.alias("constant"))


def slots(page: Page) -> list[tuple]:
    """The blocks in the content slots.

    A wrapper is not boilerplate: what stands above the article with the most
    text (on average of its path), if that is more than all articles outside
    of boilerplate hold; without an article, the outermost elements, if no text
    stands outside of them.
    """
    inside = [b for b in page.blocks if b[4] and not b[2] and "!" not in b[3]]
    if inside:
        held: Counter = Counter()
        for _, text, _, above, article, _ in inside:
            held[above, article] += len(text)
        clean = sum(n for (above, _), n in held.items() if not above)
        wrapped = {k: n / page.paths.count(k[1]) for k, n in held.items() if k[0]}
        most = max(wrapped, key=wrapped.__getitem__, default=None)
        wrappers = set(most[0]) if most and wrapped[most] > clean else set()
        return [b for b in inside if wrappers.issuperset(b[3])]
    rest = [b for b in page.blocks if b[2] != HARD and not b[4]]
    least = min((len(b[2]) for b in rest), default=0)
    return [b for b in rest if len(b[2]) == least]


def open_regions(page: Page, constant: frozenset | set) -> set[int]:
    """The regions with a text that is not constant, those around them included."""
    out: set[int] = set()
    for b in page.blocks:
        region = b[5]
        if region not in out and constant_token(b[0], b[1]) not in constant:
            while region not in out:
                out.add(region)
                region = page.within[region]
    return out


def main_text(page: Page, constant: frozenset | set) -> str:
    """The blocks in the content slots of a page without the regions that its host's template fills.

    Where the template would leave nothing, it can't be told from what the
    pages say: then the elements alone decide.
    """
    found = slots(page)
    kept = found
    if constant:
        said = open_regions(page, constant)
        kept = [b for b in found if b[5] in said]
    return "\n\n".join(b[1] for b in kept or found)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with text and n_chars, one row per page row."""
    prepare(pages.sparkSession)
    keep = keep or ["page_id", "url"]
    # one page's texts of the root, and a text for each path that always says the same: bounded by the host's markup
    held = (written(templates(pages)).where("constant").groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("constant")))
    rows = pages.select(*keep, host_of(F.col("url")).alias("_llm_host"), F.col("html").alias("_llm_html"))
    held = written(held).withColumnsRenamed({"host": "_llm_host", "constant": "_llm_constant"})
    both = rows.join(held, "_llm_host", "left").select(*keep, "_llm_html", "_llm_constant")
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [main_text(parse(h), frozenset(c or ())) if h else ""
                   for h, c in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(new, pa.string()), pa.array(map(len, new), pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    from pyspark.sql import types as T
    schema = T.StructType([pages.schema[c] for c in keep] + T.StructType.fromDDL("text string, n_chars bigint").fields)
    return both.mapInArrow(run, schema)
