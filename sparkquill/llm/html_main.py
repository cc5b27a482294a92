"""Main text of web pages by two passes of block rules.

Markup is read once into elements and blocks: runs of text between block-level tags. A page's largest article or main
element is its body; what wraps it is never boilerplate, whatever its class says. Menus, footers, sidebars, forms,
notices, adverts and comments, by tag or by a whole class, id or role, are bad. Other names that often mark boilerplate
make a block suspect, and being inside or beside the body shifts the bounds; link density, length and stop words decide.

First pass. Outside of any body: a block with many links is bad, a long one with many stop words good, a short one or one
between the bounds open, and so is code or a table's cell, whose words say little. Inside, only a short block of nearly
all links is bad; dense text and short text without links are good, the rest is open. On a page where no long block has
the stop words of a listed language, the page's own frequent short words, or characters where a script has no spaces, take
their place, and a sentence's end counts as density. Ideographs count as three characters. Suspect blocks must be dense to be more than bad. Beside a body that holds most of the dense text, a
block must be twice as long; beside a smaller one, as a teaser is, it is judged as on a page without.
Second pass. An open block takes the label of its nearest decided neighbours, inside the body those inside, with the body
itself as good where there is none; a heading takes that of what follows it.

A page is one row and one scan without backtracking over what was read, so no step looks at more than a page. Defined
results. A null or empty page has the empty text; so has one without good blocks. Unclosed tags end with what holds
them, unclosed comments, scripts and styles with the page, other embedded elements without an end at the next block; text
after a bare `<` stays text. Repeated rows each get their result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, sized

#: Frequent function words of the languages that pages are judged in.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more most no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber alle als also am an auch auf aus bei bin bis bist da das dass dem den der des die dies doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et eux fait il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vous y été être",
    "es": "a al algo como con cual cuando de del desde donde dos el ella ellos en entre era es esa ese eso esta este esto está fue ha hasta hay la las le les lo los más me mi muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una uno y ya",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Bounds of the first pass: characters, share of stop words, share of link characters; the share of a page's text that
#: makes a wrapper of it.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKED, ALL_LINKS, MOST = 70, 200, 0.15, 0.30, 0.3, 0.6, 0.6

_ATTRS = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+"""
_TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style)(?=[\s/>]){_ATTRS}>(?:.*?</(?P=raw)\s*+>|.*\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attrs>{_ATTRS})>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/><]*+)(?P<attrs2>[^<>]*+)>
    |<[!?/][^<>]*+>""",
    re.S | re.I | re.X,
)
#: Elements by what they mean for text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HELD = _BLOCK - frozenset("hr html body li dd dt td th tr thead tbody tfoot caption summary option optgroup legend".split())
_EMBEDDED = frozenset("title noscript template svg iframe object select textarea button canvas video audio".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
_BODY = frozenset(("article", "main"))
_ENDS_WITH_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())

_IDEOGRAPH = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: Scripts written without spaces, and what ends a sentence. Fixed values.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff]")
_SENTENCE_END = re.compile("[.!?…。！？।॥։؟။។][\"'”’»)\\]」』]*$")

_HINT = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Parts of names that mark boilerplate, that may mark it, that say nothing, and that deny what follows.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert alertdialog newsletter subscribe subscription signup popup modal paywall overlay sidebar share sharing sharebar nav navigation navbar breadcrumb breadcrumbs footer contentinfo complementary masthead topbar comment comments commentlist disqus reply replies respond login pagination pager toolbar skip copyright disclaimer related recommended recommendations".split()
)
_MAY_MARK = frozenset("menu search social side widget recommend promoted tags meta byline hidden".split())
_FILLERS = frozenset(
    "site page main top bottom left right upper lower list box block container wrapper wrap area section bar slot unit link links button buttons btn post posts article articles item items content form primary secondary global header inner outer text msg message google wp the my js is fixed sticky mobile desktop row col column group panel region zone big small level1 level2 1 2 3".split()
)
_DENIALS = frozenset("has with no not without hide hides".split())
SUSPECT, BAD, OPEN, INSIDE = -2, -1, 0, 1


def _hint(attrs: str) -> int:
    """BAD, SUSPECT or OPEN by the names an element bears. A name marks boilerplate as a whole: `cookie-notice` and
    `site-footer` do, `has-sidebar` and `social-history` don't."""
    if "=" not in attrs and "hidden" not in attrs.lower():
        return OPEN
    found = OPEN
    for m in _HINT.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in re.split(r"[-_]+", name) if x]
            if not parts or parts[0] in _DENIALS or not all(x in _MARKS or x in _MAY_MARK or x in _FILLERS for x in parts):
                continue
            if any(x in _MARKS for x in parts):
                return BAD
            if any(x in _MAY_MARK for x in parts):
                found = SUSPECT
    return BAD if _HIDDEN.search(attrs) else found


class Block:
    __slots__ = ("body", "element", "heading", "laid_out", "linked", "size", "state", "text")

    def __init__(self, text: str, linked: int, state: int, heading: bool, element: int = 0, body: bool = False, laid_out: bool = False):
        self.text, self.linked, self.state, self.heading, self.element, self.body = text, linked, state, heading, element, body
        #: Of code or a table; characters, of which ideographs count for more.
        self.laid_out, self.size = laid_out, len(text) if text.isascii() else len(text) + 2 * len(_IDEOGRAPH.findall(text))


class _Elements:
    """The elements that hold blocks: parent, tag, hint and characters of text. The first is the page."""

    def __init__(self):
        self.parent, self.tag, self.hint, self.chars = [0], [""], [OPEN], [0]

    def open(self, parent: int, tag: str, hint: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.chars.append(0)
        return len(self.tag) - 1

    def _largest(self, tag: str, within: int) -> int:
        """The element of a kind with the most text that no name marks, 0 if there is none."""
        inside = [i == within for i in range(len(self.tag))]
        best = 0
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
            if self.tag[i] == tag and self.hint[i] != BAD and inside[i] and self.chars[i] > (self.chars[best] if best else 0):
                best = i
        return best

    def states(self) -> list[tuple[int, bool]]:
        """Of each element its state (BAD, SUSPECT, OPEN, INSIDE) and whether it lies in an article or main element."""
        for i in range(len(self.tag) - 1, 0, -1):
            self.chars[self.parent[i]] += self.chars[i]
        main = self._largest("main", 0)
        wraps = set()
        for i in (main, self._largest("article", main)):
            while i:
                wraps.add(i)
                i = self.parent[i]
        out = [(OPEN, False)]
        for i in range(1, len(self.tag)):
            above, body = out[self.parent[i]]
            tag, hint = self.tag[i], self.hint[i]
            if i in wraps or (hint != BAD and tag in ("form", "header") and self.chars[i] > max(2 * LONG, MOST * self.chars[0])):
                hint = OPEN
            elif tag in _BAD_TAGS and not (tag == "header" and body):
                hint = BAD
            body = body or tag in _BODY
            state = BAD if BAD in (above, hint) else SUSPECT if hint == SUSPECT or (above == SUSPECT and tag not in _BODY) else INSIDE if body else OPEN
            out.append((state, body))
        return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in its order."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    elements = _Elements()
    held: list[int] = []
    n_held: Counter[str] = Counter()
    #: Elements that end with the next block, such as list items, count for their own block alone.
    own = 0
    in_link = heading = skipping = False
    skip_to = 0
    closes: dict[str, list[tuple[int, bool]]] = {}

    def flush() -> None:
        nonlocal parts, links, own
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                at = own or (held[-1] if held else 0)
                elements.chars[at] += len(text)
                out.append(Block(text, linked, OPEN, heading, at, laid_out=bool(n_held["pre"] or n_held["table"])))
            parts, links = [], []
        own = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    def pop() -> str:
        tag = elements.tag[held.pop()]
        n_held[tag] -= 1
        return tag

    def end_of(tag: str, at: int) -> int:
        """Where the embedded element that starts before `at` ends; 0 if another one starts first or none ends."""
        if tag not in closes:
            closes[tag] = [(m.end(), bool(m[1])) for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^<>]*+>", page, re.I)]
        marks = closes[tag]
        i = bisect.bisect_right(marks, (at, True))
        return marks[i][0] if i < len(marks) and marks[i][1] else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() >= skip_to and not skipping:
            add(page[max(at, skip_to) : m.start()])
        at = m.end()
        if m.start() < skip_to or m["raw"]:
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag in _EMBEDDED:
            if end:
                skipping = False
            elif not attrs.rstrip().endswith("/"):
                skip_to = end_of(tag, at)
                skipping = not skip_to
            continue
        if tag == "a":
            in_link = not end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _BLOCK:
            continue
        skipping = False
        flush()
        heading = not end and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if end:
            in_link = False
            if n_held[tag]:
                while pop() != tag:
                    pass
            continue
        while held and elements.tag[held[-1]] in _ENDS_WITH_BLOCK:
            pop()
        parent = held[-1] if held else 0
        hint = _hint(attrs) if tag != "body" else OPEN
        if tag in _HELD:
            held.append(elements.open(parent, tag, hint))
            n_held[tag] += 1
        elif hint != OPEN:
            own = elements.open(parent, tag, hint)
    if not skipping:
        add(page[max(at, skip_to) :])
    flush()
    states = elements.states()
    for b in out:
        b.state, b.body = states[b.element]
    return out


_EDGES = "'\"“”«»()[]{}.,;:!?…#*$%&|<>-–—"


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(_EDGES) in STOPS for w in words) / max(1, len(words))


def _tokens(text: str) -> list[str]:
    """Words in lower case, and single characters of the scripts without spaces."""
    out: list[str] = []
    for w in text.lower().split():
        out.extend(w if _UNSPACED.search(w) else (w.strip(_EDGES),))
    return [w for w in out if w and w not in _EDGES]


def density(found: list[Block]) -> Callable[[str], float]:
    """How dense in function words a text is, by the listed languages or else by the page itself."""
    prose = [b.text for b in found if b.state != BAD and b.size > LONG and b.linked <= LINKED * len(b.text)]
    if not prose or any(_stop_share(t) >= STOP_HIGH for t in prose):
        return _stop_share
    tokens = [w for t in prose for w in _tokens(t)]
    common = {w for w, n in Counter(w for w in tokens if len(w) <= 4).items() if n >= max(3, len(tokens) // 200)}

    def share(text: str) -> float:
        words = _tokens(text)
        own = sum(w in common for w in words) / max(1, len(words))
        return max(own, _stop_share(text), STOP_HIGH if _SENTENCE_END.search(text) else 0.0)

    return share


GOOD, NEAR, OPEN_SHORT, POOR = "good", "near", "short", "bad"


def _label(b: Block, state: int, longer: int = 1, dense: Callable[[str], float] = _stop_share) -> str:
    share = b.linked / len(b.text)
    if state == BAD:
        return POOR
    if state == INSIDE:
        if b.size < SHORT:
            return GOOD if b.heading or share <= LINKED else POOR if share >= ALL_LINKS else OPEN_SHORT
        return GOOD if dense(b.text) >= STOP_LOW else NEAR
    if share > LINKED:
        return POOR
    if b.size < SHORT:
        return POOR if (b.linked or state == SUSPECT) and not b.heading else OPEN_SHORT
    stops = dense(b.text)
    if stops >= STOP_HIGH and b.size > longer * LONG:
        return GOOD
    if stops >= STOP_LOW and state != SUSPECT:
        return NEAR
    return OPEN_SHORT if b.laid_out and state != SUSPECT else POOR


def first_pass(found: list[Block]) -> list[str]:
    dense = density(found)
    labels = [_label(b, b.state, 1, dense) for b in found]
    inside = sum(len(b.text) for b, x in zip(found, labels, strict=True) if b.body and x != POOR)
    beside = sum(len(b.text) for b, x in zip(found, labels, strict=True) if not b.body and x == GOOD)
    if inside and inside >= beside:
        for i, b in enumerate(found):
            if not b.body and labels[i] != POOR:
                labels[i] = GOOD if _label(b, b.state, 2, dense) == GOOD else POOR
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks inherit from the nearest decided block on each side, those of a body from blocks of a body. Where the
    two differ, a near one and one of a body are good, a heading is what follows it, and a short one is what the nearer
    side is, at equal distances bad."""
    n = len(labels)
    sides: list[list[tuple[str, int]]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        # The page's edges count as bad neighbours, those of a body as good ones.
        side = [(POOR, n)] * n
        seen = {False: (POOR, order.start - order.step), True: (GOOD, order.start - order.step)}
        for i in order:
            body = found[i].body
            side[i] = (seen[body][0], abs(i - seen[body][1]))
            if labels[i] in (GOOD, POOR):
                seen[body] = (labels[i], i)
        sides.append(side)
    out = []
    for i, label in enumerate(labels):
        (a, far_a), (b, far_b) = sides[0][i], sides[1][i]
        if label in (GOOD, POOR):
            out.append(label == GOOD)
        elif a == b:
            out.append(a == GOOD)
        elif label == NEAR or found[i].body:
            out.append(True)
        elif found[i].heading:
            out.append(b == GOOD)
        else:
            out.append((a if far_a < far_b else b if far_b < far_a else POOR) == GOOD)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    good = second_pass(found, first_pass(found))
    return "\n".join(b.text for b, g in zip(found, good, strict=True) if g)


def _run(batches):
    for batch in in_pieces(batches, "html", 4 << 20):
        texts = [main_text(p) if p else "" for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return sized(rows).mapInArrow(lean(_run), "page_id long, url string, text string, n_chars long")
