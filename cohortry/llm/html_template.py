"""Main text of web pages, by templates deduced from the pages of a host.

Tokens are the elements of a page, told apart by their path, and its texts, told apart by path and wording. Tokens
whose numbers of occurrences agree on every page of a host form an equivalence class. A class is valid when it covers
most of the host's different pages; classes nest as their paths do and make up the template. The valid classes that
occur once a page are its frame; what lies between them and is no template text are the slots. The slot that holds
nearly all of the varying text is the article, and it is cut out of every page of the host. A text in one valid class
with the element around it is the template's own and is cut from the slot; a text in one of several like elements stays,
since copies of an article on a host look the same.

Occurrence vectors are compared by a hash that is summed up over the pages, so a host with a third of all pages is
aggregated in parts like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import in_tasks, stored, text_or_empty
from cohortry.session import checked_broadcast

LEAST_PAGES = 3  # fewer different pages show no template; the page's own layout decides
COVER = 0.6  # share of a host's different pages that a valid class has
MAIN_SHARE = 0.9  # share of the varying text that the article's slot holds

# Element names of the HTML standard, by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul button".split()
)
# elements that are blocks of a text and no slot for one
LEAF = r">(?:p|h[1-6]|li|ul|ol|dl|dt|dd|pre|table|tbody|tr|caption|figcaption|address|blockquote|summary)(?:\.[^>]*)?$"
ARTICLE, MAIN = r">article(?:\.[^>]*)?$", r">main(?:\.[^>]*)?$"
WHOLE = frozenset("html body main article".split())  # never apart by a class, id or role
APART = frozenset("head nav header footer aside form menu dialog button select fieldset search".split())
# an element of the first kind ends an open one of the second
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
# Names that sites give to parts beside the article, as whole words of a class, id or role.
BESIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|disqus|search|pagination|pager|toolbar|"
    r"widget|copyright|complementary|contentinfo)(?:$|[-_\s])",
    re.I,
)
MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<data>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*))")
# attributes up to the sign that ends a tag outside quotes; a quote that is never closed is a sign like others
ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NUMBERS = re.compile(r"[0-9]+")
SPACE = re.compile(r"\s+")
MAX_DEPTH = 128  # block elements nested deeper than this count as the one they stand in
MAX_LABEL = 80  # characters of an element's name and classes; longer ones are named by a hash


class Tags:
    """The tags of a page, one after another, in time linear in the page.

    ``next()`` gives (start, end, name, attributes, closes) or none; comments and declarations have an empty name. A
    ``<`` that no ``>`` follows is text. Where the quotes of a tag hide every ``>`` to the end of the page, they are
    broken: that tag and all after it end at the next ``>``.
    """

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.last = html.rfind(">")
        self.broken = False

    def next(self) -> tuple[int, int, str, str, bool] | None:
        html = self.html
        while (mark := MARK.search(html, self.at)) is not None:
            start, at = mark.span()
            self.at = at
            if mark["comment"] or mark["data"]:
                closer = "-->" if mark["comment"] else "]]>"
                end = html.find(closer, at)
                self.at = len(html) if end < 0 else end + len(closer)
                return start, self.at, "", "", False
            if self.last < at:
                continue
            tag = None if self.broken or mark["other"] else ATTRIBUTES.match(html, at)
            if tag is None:
                self.broken |= not mark["other"]
                self.at = html.index(">", at) + 1
            else:
                self.at = tag.end()
            return start, self.at, (mark["name"] or "").lower(), html[at : self.at - 1], bool(mark["end"])
        return None

    def skip(self, name: str) -> None:
        """Go behind the end tag of an element that holds no markup, or to the end of the page."""
        closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, self.at)
        end = self.html.find(">", closing.end()) if closing else -1
        self.at = len(self.html) if end < 0 else end + 1


class Page:
    """``blocks``: (path, text, apart) in page order; ``opened``: how often each element path begins."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, bool]] = []
        self.opened: Counter[str] = Counter()
        self._paths, self._parents = [""], [0]  # of the elements' nodes; a path has one node, its parent a smaller number
        self._nodes = {"": 0}
        self._stack: list[tuple[str, int, tuple[int, ...]]] = []  # name, node, the marked elements from the outermost on
        self._deeper = 0  # open elements below the deepest that counts
        self._held: list[tuple[int, str, tuple[int, ...]]] = []  # node, text, marked elements
        self._marked = 0
        self._parts: list[str] = []
        tags, at = Tags(html), 0
        while (tag := tags.next()) is not None:
            start, at_end, name, attributes, closes = tag
            self._parts.append(html[at:start])
            at = at_end
            if not name:
                continue
            if closes:
                self._close(name)
            elif name == "br":
                self._parts.append("\n")
            elif name in RAW:
                if not attributes.endswith("/"):
                    tags.skip(name)
                    at = tags.at
            elif name in BLOCK:
                self._open(name, attributes)
        self._parts.append(html[at:])
        self._flush()
        around = self._around()
        self._sides = [any(m not in around for m in marked) for _, _, marked in self._held]
        self.blocks = [(self._paths[node], text, apart) for (node, text, _), apart in zip(self._held, self._sides, strict=True)]

    def _around(self) -> set[int]:
        """Marked elements that are no parts beside the article, since they hold most of the text and hardly any is outside.

        From the outermost on, as long as the marks leave less than a tenth of the text.
        """
        around: set[int] = set()
        whole = sum(len(text) for _, text, _ in self._held)
        while True:
            left, below = 0, Counter()
            for _, text, marked in self._held:
                first = next((m for m in marked if m not in around), None)
                if first is None:
                    left += len(text)
                else:
                    below[first] += len(text)
            largest = max(below, key=below.get, default=None)
            if largest is None or left >= (1 - MAIN_SHARE) * whole or 2 * below[largest] <= whole:
                return around
            around.add(largest)

    def _flush(self) -> None:
        text = SPACE.sub(" ", unescape("".join(self._parts))).strip()
        self._parts = []
        if text:
            _, node, marked = self._stack[-1] if self._stack else ("", 0, ())
            self._held.append((node, text, marked))

    def _open(self, name: str, attributes: str) -> None:
        self._flush()
        if name == "hr":
            return
        if self._deeper or len(self._stack) >= MAX_DEPTH:
            self._deeper += 1
            return
        if self._stack and self._stack[-1][0] == "p":  # a paragraph holds no blocks
            self._stack.pop()
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in SCOPE.get(name, ()):
                break
            if self._stack[k][0] in IMPLIED_END.get(name, ()):
                del self._stack[k:]
                break
        _, parent, marked = self._stack[-1] if self._stack else ("", 0, ())
        names = [a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)] if attributes else []
        if name in APART or (name not in WHOLE and any(BESIDE.search(n) for n in names)):
            marked = (*marked, self._marked)
            self._marked += 1
        label = ".".join([name, *sorted(NUMBERS.sub("", n) for n in names)])
        if len(label) > MAX_LABEL:
            label = f"{name}.{xxhash.xxh64_hexdigest(label)}"
        path = f"{self._paths[parent]}>{label.replace('>', '')}"
        self.opened[path] += 1
        node = self._nodes.setdefault(path, len(self._paths))
        if node == len(self._paths):
            self._paths.append(path)
            self._parents.append(parent)
        self._stack.append((name, node, marked))

    def _close(self, name: str) -> None:
        if name not in BLOCK:
            return
        self._flush()
        if self._deeper:
            self._deeper -= 1
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                del self._stack[k:]
                return

    def volume(self) -> Counter[str]:
        """Characters of text below each path that is not apart."""
        below = [0] * len(self._paths)
        for (node, text, _), apart in zip(self._held, self._sides, strict=True):
            if not apart:
                below[node] += len(text)
        for node in range(len(below) - 1, 0, -1):  # from the leaves up
            below[self._parents[node]] += below[node]
        return Counter({path: n for path, n in zip(self._paths, below, strict=True) if n})

    def main_path(self) -> str:
        """The element, opened once, that holds most of the page's text beside the parts apart.

        Of several an article element, then a main element, then the deepest.
        """
        chars = self.volume()
        least = MAIN_SHARE * chars[""]
        held = [p for p, n in self.opened.items() if n == 1 and chars[p] and chars[p] >= least and not re.search(LEAF, p)]
        order = lambda p: (bool(re.search(ARTICLE, p)), bool(re.search(MAIN, p)), p.count(">"), p)
        return max(held, key=order, default="")

    def text(self, main: str | None, template: Collection[int] = ()) -> str:
        """The blocks below ``main``, or below the page's own main element where it has no such element.

        ``template``: tokens of texts that belong to the host's template and are left out.
        """
        if main is None or main not in self.opened:
            main = self.main_path()
        inside = f"{main}>"
        held = ((p, t) for p, t, apart in self.blocks if not apart and (p == main or p.startswith(inside) or not main))
        return "\n".join(t for p, t in held if not template or text_token(p, t) not in template)


def text_token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1 or 1


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to one row per token: host, page, path, wording, count, chars.

    ``wording`` is 0 for an element and a hash of path and text for a text; ``chars`` is the text below an element, or the length of
    the text. The empty path stands for the page.
    """
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            source = html.as_py()
            page, parsed = xxhash.xxh64_intdigest(source) >> 1, Page(source)
            chars = parsed.volume()
            rows += [(host, page, p, 0, n, chars[p]) for p, n in {"": 1, **parsed.opened}.items()]
            texts = Counter((p, t) for p, t, apart in parsed.blocks if not apart)
            rows += [(host, page, p, text_token(p, t), n, len(t)) for (p, t), n in texts.items()]
        names = ["host", "page", "path", "wording", "count", "chars"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, path, wording, pages, occurrences, chars, vector): tokens with their occurrence vector's hash.

    Tokens of one host that agree in pages, occurrences and vector are one class. Equal pages count once. Tokens on
    a single page and texts of a single page are left to the pages themselves.
    """
    tokens = in_tasks(
        pages, page_tokens, "host string, page long, path string, wording long, count long, chars long"
    ).dropDuplicates(["host", "page", "path", "wording"])
    grouped = tokens.groupBy("host", "path", "wording").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("count").alias("occurrences"),
        F.sum(F.col("chars") * F.when(F.col("wording") == 0, 1).otherwise(F.col("count"))).alias("chars"),
        F.bit_xor(F.xxhash64("page", "count")).alias("vector"),
    )
    return grouped.where((F.col("pages") > 1) | (F.col("wording") == 0))


def templates(classes: DataFrame) -> DataFrame:
    """(host, main, texts): the path of the article's slot and the tokens of template texts, for hosts with enough pages.

    Where the template texts hold nearly all of the slot, the pages are copies of one article and the texts stay.
    """
    sizes = classes.where((F.col("path") == "") & (F.col("wording") == 0)).select("host", F.col("pages").alias("all"))
    sized = classes.join(sizes.where(F.col("all") >= LEAST_PAGES), "host")
    valid = sized.where(F.col("pages") >= COVER * F.col("all"))
    fixed = valid.where(F.col("wording") != 0)  # template texts fill no slot
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), ">"))
    fixed = fixed.select("host", F.explode(above).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("fixed"))
    # a class is named by what its tokens share; those that occur once on each of their pages form the frame
    frame = valid.where((F.col("wording") == 0) & (F.col("occurrences") == F.col("pages")))
    frame = frame.join(fixed, ["host", "path"], "left")
    frame = frame.select("host", "path", "chars", (F.col("chars") - F.coalesce("fixed", F.lit(0))).alias("varying"), "vector")
    whole = frame.where(F.col("path") == "").select("host", F.col("varying").alias("whole"))
    slots = frame.join(whole, "host").where((F.col("varying") >= MAIN_SHARE * F.col("whole")) & (F.col("varying") > 0))
    # of the nest of classes that hold the text: an article element, a main element, or else the innermost
    order = F.struct(
        F.col("path").rlike(ARTICLE).alias("article"),
        F.col("path").rlike(MAIN).alias("main"),
        F.size(F.split("path", ">")).alias("depth"),
        "path",
        (F.col("varying") < (1 - MAIN_SHARE) * F.col("chars")).alias("copies"),
    )
    best = slots.where(~F.col("path").rlike(LEAF)).groupBy("host").agg(F.max(order).alias("best"))
    # a text is the template's where it shares its class with its own element, which then never holds another text
    same = ["host", "path", "pages", "occurrences", "vector"]
    nested = valid.where((F.col("wording") == 0) & (F.col("pages") >= LEAST_PAGES)).select(same)
    texts = valid.where(F.col("wording") != 0).join(nested, same)
    texts = texts.groupBy("host").agg(F.collect_set("wording").alias("texts"))
    return best.join(texts, "host", "left").select(
        "host", F.col("best.path").alias("main"), F.when(~F.col("best.copies"), F.col("texts")).alias("texts")
    )


def cut_articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, main, texts) to (page_id, url, text)."""
    for batch in batches:
        templates_ = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True)
        texts = [Page(html.as_py()).text(main, frozenset(fixed.as_py() or ())) for html, main, fixed in templates_]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the article's blocks in page order, joined by \\n.

    White space inside a block becomes one space; character references are decoded. Parts whose element or whose
    class, id or role says that they lie beside the article (menus, headers, footers, sidebars, notices, adverts,
    forms, comments) are left out wherever they stand, but html, body, main and article are none, nor is an element that
    holds most of the page's text where less than a tenth would be left. Left out are scripts and styles as well, and texts of the host's
    template (on at least 60 % of its different pages, in an element with no other text). Where a host has fewer than three
    different pages, or a page lacks the host's article slot, the page's own layout decides by the same rule.

    Broken markup ends where its page ends: a tag without ``>`` is text, unclosed comments and scripts hide the rest, and
    block elements nested more than ``MAX_DEPTH`` deep count as the one they stand in.

    A null html is empty and gives an empty text; a null or malformed url has the empty host. Null ids and repeated
    rows are kept as they are; repeated pages count once for the template. Further columns are ignored. An empty
    table gives no rows.
    """
    host = F.lower(F.regexp_extract(text_or_empty(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text_or_empty(html_column).alias("html"), host.alias("host")
    )
    classes = stored(equivalence_classes(source.select("host", "html")), "tokens")
    main = checked_broadcast(templates(classes))
    joined = source.join(main, "host", "left").select("page_id", "url", "html", "main", "texts")
    schema = f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string"
    return in_tasks(joined, cut_articles, schema).withColumn("n_chars", F.length("text").cast("long"))
