"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  A name (class or id) that tells of furniture counts neither on html, body and main, nor on the
first article element and what contains it; on later articles only as a whole class, so that reader comments stay marked.  A block is described by its words and link density, those of the blocks before and
after it, and where it stands: inside an element that names itself as page furniture, and inside or outside an article element if the page has
one.  The tree is grown on the small labelled table below.  Blocks it takes for text are joined in page order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import text_of

#: Fixed values of HTML: elements that part blocks, those whose content is no text, and those that hold page furniture.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog button search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open paragraph, and those whose own class and id say nothing of their content.
ENDS_P = BLOCK - frozenset("body button caption html legend optgroup option select summary tbody td tfoot th thead title tr".split())
WHOLE = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in class and id that name page furniture, and those that name the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside "
    "related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search widget comment "
    "comments reply replies respond disqus copyright legal pagination pager tags toolbar skip".split()
)
HEADS = frozenset("header head masthead".split())
MAIN_NAMES = frozenset("article content story main".split())

#: Labelled blocks: text or not | furniture, article (1 inside, 0 none on the page, -1 outside) | words, link density | the same of the block before | after.
LABELLED = """
1 0 1 8 0 0 0 60 0;    1 0 1 60 0 8 0 45 0;   1 0 1 1 0 40 0 70 0;    1 0 1 3 0 25 0 0 0;    1 0 1 12 1 50 0 40 0;   1 0 1 120 0.1 4 0 9 0
1 0 1 2 0 6 0 8 0;     1 0 1 30 0.5 0 0 20 0; 1 0 1 5 1 0 0 0 0;      1 0 1 400 0 1 0 1 0;   1 0 1 1 0 0 0 0 0;      1 0 1 15 0.3 15 0.2 15 0
0 1 1 1 1 1 1 1 1;     0 1 1 12 0 80 0 60 0;  0 1 1 60 0 70 0 50 0;   0 1 1 6 0 90 0 0 0;    0 1 1 25 0.1 8 0 30 0;  0 1 1 3 0.5 5 0 4 0
0 1 0 1 1 1 1 1 1;     0 1 0 9 0 1 1 50 0;    0 1 0 70 0 50 0 40 0;   0 1 0 4 0.8 3 1 2 1;   0 1 0 20 0 0 0 300 0;   0 1 0 150 0 30 0 8 0
0 1 -1 1 1 1 1 1 1;    0 1 -1 8 0 1 1 7 0;    0 1 -1 12 0.2 60 0 0 0; 0 1 -1 45 0 3 1 20 0;  0 1 -1 2 1 2 1 9 0;     0 1 -1 100 0 60 0 3 0
0 0 -1 1 1 0 0 1 1;    0 0 -1 8 0 1 1 9 0;    0 0 -1 40 0 8 0 30 0;   0 0 -1 6 0.4 80 0 0 0; 0 0 -1 90 0 50 0 5 1;   0 0 -1 3 0 0 0 2 0
1 0 0 60 0 8 0 45 0;   1 0 0 45 0 60 0 30 0;  1 0 0 90 0.1 1 1 60 0;  1 0 0 35 0 50 0 2 1;   1 0 0 150 0.05 0 0 0 0; 1 0 0 25 0.2 40 0 60 0
1 0 0 5 0 70 0 50 0;   1 0 0 2 0 45 0 90 0;   1 0 0 8 0 1 1 60 0;     1 0 0 12 0 30 0 25 0;  1 0 0 18 0 40 0.1 3 1;  1 0 0 10 0.1 35 0 80 0
0 0 0 1 1 1 1 1 1;     0 0 0 2 1 3 1 40 0;    0 0 0 5 1 60 0 4 1;     0 0 0 4 0 1 1 1 1;     0 0 0 6 0.5 2 1 3 1;    0 0 0 20 0.9 1 1 2 1
0 0 0 30 0.8 5 1 9 1;  0 0 0 3 0 2 1 5 0;     0 0 0 7 0 3 0 0 0;      0 0 0 2 0 0 0 1 1;     0 0 0 8 0.6 50 0 60 0;  0 0 0 12 0.7 5 0.5 8 1
"""


class Tree:
    """A classification tree by the Gini index over feature columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7):
        self.value, self.feature = float(y.mean()) >= 0.5, -1
        if depth == 0 or y.min() == y.max():
            return
        best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for cut in (levels[1:] + levels[:-1]) / 2:
                low = x[:, f] <= cut
                impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best[1] >= 0:
            _, self.feature, self.cut = best
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def trained() -> Tree:
    rows = np.array([[float(v) for v in row.split()] for row in re.split(r"[;\n]", LABELLED) if row.strip()])
    return Tree(rows[:, 1:], rows[:, 0])


def names_in(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


class Blocks(HTMLParser):
    """Reads a page into blocks (text, words, words in links, inside furniture, inside an article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, silent, furniture, article: of this element or one around it
        self.firm: list[bool] = []  # furniture by tag or role, not by name alone, for each open element
        self.articles = 0
        self.text: list[str] = []
        self.linked: list[str] = []
        self.links = 0
        self.paired = False  # an article element was seen

    def here(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def close_from(self, i: int) -> None:
        del self.open[i:], self.firm[i:]

    def end_open(self, tag: str, within: frozenset) -> None:
        """Ends the last open ``tag`` unless an element of ``within`` was opened in it since."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_from(i)
                return
            if self.open[i][0] in within:
                return

    def end_block(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                silent, furniture, article = self.here()
                self.blocks.append((" ".join(words), len(words), len("".join(self.linked).split()), furniture, article))
            self.text, self.linked = [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_block()
        elif tag == "br":
            self.text.append(" ")
            self.linked.append(" ")
        if tag in ENDS_P:
            self.end_open("p", BLOCK)
        if tag == "li":
            self.end_open("li", frozenset(("ul", "ol", "menu")))
        if tag == "a":
            self.links += 1
        if tag in VOID or tag == "p" or tag == "li":
            tag_only = dict(attrs) if tag in ("p", "li") else {}
            if not tag_only.get("class") and not tag_only.get("id"):
                return
        if tag not in BLOCK and tag not in SILENT and not attrs:
            return
        silent, furniture, article = self.here()
        named = dict(attrs)
        names = names_in(f"{named.get('class') or ''} {named.get('id') or ''}") if "class" in named or "id" in named else set()
        firm = bool(self.firm) and self.firm[-1]
        if tag in WHOLE:
            names = set()
        elif tag == "article":
            self.articles += 1
            names = set((named.get("class") or "").lower().split()) if self.articles > 1 else set()
            furniture = furniture if self.articles > 1 else firm
        role = (named.get("role") or "").lower()
        inside = article
        if tag in ("article", "main") or role in ("main", "article") or (tag in ("div", "section") and names & MAIN_NAMES and not names & NAMES):
            inside, self.paired = True, self.paired or not furniture
        furnishing = tag in FURNITURE or role in ROLES or bool(names & NAMES) or ((tag == "header" or bool(names & HEADS)) and not inside)
        hidden = "hidden" in named or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        if tag in BLOCK or tag in SILENT or furnishing or hidden:
            self.open.append((tag, silent or tag in SILENT or hidden, furniture or furnishing, inside))
            self.firm.append(firm or tag in FURNITURE or role in ROLES)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT:
            return
        if self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        if tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_from(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.here()[0]:
            self.text.append(data)
            if self.links:
                self.linked.append(data)


def blocks_of(html: str) -> tuple[list[tuple[str, int, int, bool, bool]], bool]:
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return reader.blocks, reader.paired


def described(blocks: list[tuple[str, int, int, bool, bool]], paired: bool) -> np.ndarray:
    """A row of features per block, in the order of the labelled table."""
    own = np.array([(b[1], b[2] / b[1]) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    place = np.array([(b[3], (1 if b[4] else -1) if paired else 0) for b in blocks], float).reshape(-1, 2)
    return np.hstack([place, own, np.vstack([edge, own[:-1]]) if len(own) else own, np.vstack([own[1:], edge]) if len(own) else own])


def main_text(html: str, tree: Tree) -> str:
    blocks, paired = blocks_of(html)
    return "\n\n".join(b[0] for b, keep in zip(blocks, tree.predict(described(blocks, paired))) if keep) if blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page.

    Null and empty pages, and pages without a text block, give an empty text.  Cut-off pages are read as far as they go, repeated
    rows alike, an empty table gives an empty table.  Other columns are not read.
    """
    tree = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
