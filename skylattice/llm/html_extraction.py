"""HTML extraction: flat text blocks, described by word count and link density of themselves and their neighbours, judged by a
decision tree.

A page is cut into flat blocks of text at its block-level tags (``flat_blocks``, a small helper that Spark's workers run over Arrow
batches). Each block gets features from itself, the blocks before and after it, and the elements around it (``features``); a
decision tree of Spark's own, trained on the blocks of a small labelled table (``labelled_blocks``), tells main text from the rest.
The tree is small, so it is turned into one CASE expression over the array of a page's blocks: pages stay rows of their own from
the scan to the result, nothing is shuffled, and a page's size only matters to its own row.

Text is what a browser would show: character references are decoded once (also those without a semicolon that HTML knows), scripts,
styles, comments, templates and embedded media are no text, an unknown or inline tag doesn't part words, ``<br>`` is white space, an
unfinished tag, comment or script at the end of a page is dropped, a ``<`` that starts no tag is text. White space is Unicode's.

Defined cases: null and empty html, and pages without main text, give an empty text and 0 characters; rows are judged one by one,
so null or repeated page_ids and equal pages change nothing; very long pages are judged whole; an empty table gives no rows; missing
end tags close at the end of the next enclosing element that ends; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import steps, table

#: Elements of HTML that end a line of text, that hold no text to read, that close an open one of their kind.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("audio canvas iframe math noembed noframes noscript object script style svg template title video".split())
CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements, roles and words of class or id that surround other things than main text, and those around main text.
ASIDE_TAGS = frozenset("nav footer aside form button select textarea dialog menu label fieldset search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related reply replies respond "
    "review reviews search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content entry main post story text".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment
    r"|<[!?][^>]*+>?"  # a declaration
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<shut>>?)"
    r"|[^<]++|<",
    re.DOTALL,
)
NAMES = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK = "struct<text: string, words: int, linked: int, tag: string, aside: boolean, main: boolean>"


def surroundings(tag: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is one around other things than main text, and whether it is one around main text."""
    aside, main = tag in ASIDE_TAGS, tag in MAIN_TAGS
    for name, *values in NAMES.findall(rest) if rest else ():
        name, value = name.lower(), "".join(values)
        if name == "role":
            aside, main = aside or value.lower() in ASIDE_ROLES, main or value.lower() in MAIN_TAGS
        elif name == "hidden" or name == "aria-hidden":
            aside |= name == "hidden" or value.lower() == "true"
        elif tag not in ("html", "body", "main"):
            words = {w.lower() for w in PARTS.findall(value)}
            aside, main = aside or not words.isdisjoint(ASIDE_WORDS), main or not words.isdisjoint(MAIN_WORDS)
    return aside, main


def flat_blocks(page: str | None) -> list[tuple]:
    """A page's blocks of text in order: text, words, words inside links, the block's own tag, in an aside, in main text."""
    out, pieces, page, at = [], [], page or "", 0
    opened = Counter()
    around = [("", False, False, False)]  # open elements: tag, in an aside, in main text, in a header
    tag, own, link, linked = "", False, False, 0  # of the block at hand: its tag, whether its own names say aside; inside a link, words that were

    def end() -> None:
        words = "".join(pieces).split()
        pieces.clear()
        if words:
            _, aside, main, header = around[-1]
            out.append((" ".join(words), len(words), min(linked, len(words)), tag, aside or own or header and tag not in HEADINGS, main))

    while m := TOKEN.match(page, at):
        at, name, closing = m.end(), (m["tag"] or "").lower(), bool(m["end"])
        if not name:
            if m[0][0] != "<" or len(m[0]) == 1:  # text, no comment or declaration
                pieces.append(references.unescape(m[0]))
                linked += len(pieces[-1].split()) if link else 0
        elif not m["shut"]:
            break  # the page ends within a tag
        elif name in SILENT_TAGS and not closing:
            if not (m["rest"].endswith("/") and name in ("svg", "math")):
                rest = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if not rest:
                    break
                at = rest.end()
        elif name == "a":
            link = not closing
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK_TAGS:
            end()
            tag, own, linked = "" if closing else name, False, 0
            if closing:
                while opened[name]:  # what is still open within it ends with it
                    last = around.pop()[0]
                    opened[last] -= 1
                    link = False
                    if last == name:
                        break
                continue
            while around[-1][0] in CLOSED_BY.get(name, ()):
                opened[around.pop()[0]] -= 1
            _, aside, main, header = around[-1]
            own_aside, own_main = surroundings(name, m["rest"])
            if name == "p" or name == "hr" or name in HEADINGS:  # can be without an end tag, so they only speak for their own block
                own = own_aside
            else:
                opened[name] += 1
                around.append((name, aside or own_aside or name == "header" and not main, main or own_main, header or name == "header"))
    end()
    return out


def blocks(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, blocks."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("tag", pa.string()), ("aside", pa.bool_()), ("main", pa.bool_())]))
    names = [f.name for f in kind.value_type]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(iter((batch,)), "html"):
                found = [[dict(zip(names, b)) for b in flat_blocks(page)] for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, kind)], ["page_id", "url", "blocks"])

    rows = pages.select("page_id", "url", "html")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(cut, f"{kept}, blocks array<{BLOCK}>")


#: What the tree sees of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "aside", "main", "paragraph", "heading")


def features(all_blocks: Column, i: Column) -> list[Column]:
    """The features of block i (from 0), in the order of FEATURES; where there is no neighbour, it has no words."""
    block = lambda k: F.get(all_blocks, i + k)
    words = lambda k: F.coalesce(block(k)["words"], F.lit(0)).cast("double")
    density = lambda k: F.coalesce(block(k)["linked"] / block(k)["words"], F.lit(0.0))
    flag = lambda c: c.cast("int").cast("double")
    tag = block(0)["tag"]
    near = [f(k) for k in (0, -1, 1) for f in (words, density)]
    return [*near, flag(block(0)["aside"]), flag(block(0)["main"]), flag(tag.isin("p", "pre", "blockquote")), flag(tag.isin(*sorted(HEADINGS)))]


#: The layouts of the labelled table. [+n] stands for n words of main text, [-n] for n words of something else.
LAYOUTS = {
    "news": "<header><a href=/>[-2]</a><p>[-5]</p></header><nav><ul><li><a href=/a>[-1]</a></li><li><a href=/b>[-2]</a></li></ul></nav><main><article><h1>[+7]</h1><p>[+40]</p>"
    "<p>[+3]</p><p>[+1]</p><h2>[+4]</h2><p>[+25] <a href=/c>[+2]</a> [+9]</p><figure><figcaption>[+6]</figcaption></figure><p>[+18]</p></article></main><aside><h3>[-2]</h3><ul><li><a href=/d>[-6]</a></li></ul></aside><footer><p>[-14]</p></footer>",
    "bare article": "<nav><a href=/>[-1]</a> <a href=/x>[-1]</a></nav><div class=ad>[-9]</div><article><h1>[+6]</h1><p>[+2]</p><p>[+30]</p><p>[+1]</p><ul><li>[+3]</li><li>[+12]</li></ul></article><footer>[-11]</footer>",
    "short article": "<nav><a href=/>[-2]</a></nav><div class=banner>[-20]</div><article><h1>[+3]</h1><p>[+3]</p></article><footer>[-7]</footer>",
    "link list article": "<nav><a href=/>[-2]</a></nav><article><h1>[+4]</h1><p>[+15]</p><ul><li><a href=/1>[+3]</a></li><li><a href=/2>[+4]</a> [+1]</li></ul><p><a href=/3>[+5]</a></p></article><div class=related><a href=/4>[-5]</a></div><footer>[-9]</footer>",
    "soup": "<div><a href=/>[-1]</a> <a href=/b>[-1]</a> <a href=/c>[-1]</a></div><div><h1>[+6]</h1><p>[+35]</p><p>[+28]</p><p>[+9]</p><p>[+41]</p></div><div><a href=/d>[-4]</a><a href=/e>[-4]</a></div><div>[-6]</div>",
    "soup of divs": "<div><div><a href=/>[-2]</a></div><div><a href=/2>[-1]</a></div></div><div>[+30]</div><div>[+12]</div><div>[+33]</div><div><a href=/3>[-3]</a></div><div>[-4]</div>",
    "old table": "<table><tr><td><a href=/>[-1]</a></td><td><a href=/2>[-1]</a></td></tr></table><table><tr><td><a href=/3>[-2]</a><td><h1>[+5]</h1><p>[+38]<p>[+14]<p>[+22]</td></tr></table><table><tr><td>[-5]</td></tr></table>",
    "blog": "<div id=header><h1><a href=/>[-3]</a></h1></div><div id=content><div class=post><h2>[+5]</h2><p>[+21]</p><p>[+2]</p><blockquote>[+17]</blockquote><p>[+26]</p></div><div id=comments><h3>[-2]</h3><ol><li><p>[-24]</p></li><li><p>[-5]</p></li></ol><form><p>[-4]</p><label>[-1]</label></form></div></div>"
    "<div id=sidebar><h3>[-1]</h3><p>[-19]</p><ul><li><a href=/r>[-2]</a></li></ul></div><div id=footer><p>[-8]</p></div>",
    "comments as articles": "<main><article><h1>[+4]</h1><p>[+31]</p><p>[+5]</p></article><section class=comments><article><p>[-18]</p></article><article><p>[-32]</p></article></section></main><footer><a href=/>[-1]</a></footer>",
    "consent": "<div class=cookie-notice><p>[-28]</p><button>[-1]</button></div><div role=navigation><a href=/>[-2]</a></div><div role=main><h1>[+5]</h1><p>[+16]</p><p>[+4]</p></div><div role=contentinfo><p>[-15]</p></div>",
    "advert inside": "<article><h1>[+5]</h1><p>[+20]</p><div class=advert><p>[-12]</p></div><p>[+24]</p><aside><p>[-16]</p></aside><p>[+3]</p><div class=newsletter-signup><form><p>[-10]</p><button>[-1]</button></form></div><p>[+19]</p><footer><a href=/t>[-1]</a></footer></article>",
    "form": "<header><nav><a href=/>[-1]</a></nav></header><main><h1>[+3]</h1><p>[+13]</p><form><label>[-2]</label><select><option>[-1]</option><option>[-2]</option></select><p>[-9]</p><button>[-2]</button></form><p>[+8]</p></main><footer>[-3]</footer>",
    "head of article": "<article><header><h1>[+7]</h1><p>[-4]</p></header><p>[+29]</p><pre>[+8]</pre><p>[+2]</p><table><tr><th>[+1]</th><td>[+2]</td></tr></table></article><div class=share-bar><a href=/f>[-1]</a></div><div class=disclaimer>[-22]</div>",
    "plain": "<p>[+14]</p><p>[+2]</p><p>[+33]</p><h2>[+3]</h2><p>[+11]</p>",
    "plain with footer": "<h1>[+5]</h1><p>[+27]</p><p>[+19]</p><p>[+6]</p><p>[+30]</p><hr><a href=/>[-1]</a> <a href=/b>[-1]</a>",
    "portal": "<div class=topbar>[-4]</div><ul><li><a href=/1>[-2]</a></li><li><a href=/2>[-1]</a></li><li><a href=/3>[-3]</a></li></ul><h1>[+8]</h1><p>[+22]</p><p>[+37]</p><ul><li><a href=/4>[-7]</a></li><li><a href=/5>[-9]</a></li></ul><p><a href=/6>[-2]</a></p>",
}
#: Every layout comes with its lengths multiplied by these.
STRETCH = (1, 2, 5)


def labelled_pages() -> list[tuple[str, str]]:
    """The small labelled table, by rule: layout, page. Words of main text start with an m, others with an n; no feature sees words."""
    slot = re.compile(r"\[([+-])(\d+)\]")
    fill = lambda by: lambda m: " ".join("mn"["+-".index(m[1])] + "o" * (k % 5) for k in range(int(m[2]) * (by if int(m[2]) > 8 else 1)))
    return [(name, slot.sub(fill(by), layout)) for name, layout in LAYOUTS.items() for by in STRETCH]


def labelled_blocks(spark: SparkSession, pages: list[tuple[str, str]] | None = None) -> DataFrame:
    """layout, label (1: main text) and the feature vector `_x` of every block of the labelled pages."""
    pages = labelled_pages() if pages is None else pages
    cut = blocks(spark.createDataFrame([(k, name, page) for k, (name, page) in enumerate(pages)], "page_id long, url string, html string"))
    rows = F.transform("blocks", lambda b, i: F.struct(F.when(b["text"].startswith("m"), 1.0).otherwise(0.0).alias("label"), F.array(*features(F.col("blocks"), i)).alias("x")))
    return cut.select(F.col("url").alias("layout"), F.explode(rows).alias("r")).select("layout", "r.label", array_to_vector("r.x").alias("_x"))


def fit(labelled: DataFrame, depth: int = 6) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(featuresCol="_x", maxDepth=depth, minInstancesPerNode=2, seed=1).fit(labelled.coalesce(1))


def kept_by(model: DecisionTreeClassificationModel, values: list[Column]) -> Column:
    """The tree as one expression over its features: true for main text."""

    def below(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        return F.when(values[split.featureIndex()] <= split.threshold(), below(node.leftChild())).otherwise(below(node.rightChild()))

    return below(model._java_obj.rootNode())


def extract(pages: DataFrame, model: DecisionTreeClassificationModel) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars."""
    all_blocks = F.col("blocks")
    kept = F.filter(all_blocks, lambda b, i: kept_by(model, features(all_blocks, i)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return blocks(pages).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def default_model(spark: SparkSession) -> DecisionTreeClassificationModel:
    return fit(labelled_blocks(spark))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), default_model(spark))
