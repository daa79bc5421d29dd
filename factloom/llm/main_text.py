"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words, which score positive, and tags, which score negative; one linear scan finds the contiguous
run of the greatest sum. The weights come from labelled pages: pages whose markup names its content (article or main) are
labels for themselves, and a structured perceptron, that does not see those tags, moves the weights until the scan finds that region.

Elements whose tag, role, class or id speaks of boilerplate (menus, adverts, comments ...) are suspects. Words of a suspect score
negative and are left out of the region's text, unless it holds the content: the page's article, or far more words than all
text outside of suspects. Named content counts in the scan as a border that costs ``BORDER`` to cross; a run inside it stands for
all of it, siblings and nested ones together. Elements end with their parent; a page of any length or brokenness is read in linear time.

Null html is empty; a page without words has an empty text; each row is a page of its own even if its page_id repeats; of
equal runs the first wins; nothing is cut off, however long the page; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that are read by the driver to fit the weights, the least by hash of the url and html, none longer than LONGEST characters.
LABELLED, LONGEST = 400, 100_000
EPOCHS = 6
BORDER = 1000.0
#: A suspect holds the content if it has at least WHOLE words and the text outside of suspects has less than a REST-th share of them.
WHOLE, REST = 50, 0.25

RAW = re.compile(r"<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A quote opens a value only right after an equals sign.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)>""")
LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags inside a block of text; all others end it.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag ends without an end tag: an open element of these names, unless one of the others is open inside.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DEEP = 64
BOILERPLATE = frozenset("nav footer aside form button dialog menu".split())
ROLES = re.compile(r"""\brole\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)""", re.I)
NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNWANTED = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr menu modal nav navbar"
    " navigation newsletter notice notices pagination pager popup promo promos promoted related replies reply share sharing sidebar signup skip social sponsor"
    " sponsored sponsors subscribe tags toolbar widget widgets".split()
)
TOP = frozenset("header masthead topbar sitetitle".split())
WANTED = frozenset("post article content entry story main body text page wrapper container".split())
#: A name that begins so tells what is beside the element or missing from it.
LAYOUT = re.compile(r"(?:no|has|with|without|hide|show|is)[_-]", re.I)
LANDMARKS = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")
WORD, LINKED, LEFT_OUT = "", " linked", " left out"
#: Weights before fitting; "?" is any other tag's.
FIRST = {"?": -0.3, LINKED: -0.2, LEFT_OUT: -0.3, WORD: 1.0, "li": -0.5, "a": -0.3} | dict.fromkeys("table thead tbody tr td th".split(), -0.1) | dict.fromkeys(INLINE - {"a"}, -0.05)


def _suspect(name: str, attrs: str, inside: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    if not attrs or name in LANDMARKS or name in ("body", "html"):
        return False
    if ROLES.search(attrs):
        return True
    bad = False
    for m in NAMED.finditer(attrs):
        for one in (m[1] or m[2] or m[3] or "").lower().split():
            if one in WANTED:
                return False
            if not LAYOUT.match(one):
                bad = bad or any(part in UNWANTED or (part in TOP and not inside) for part in re.split(r"[_-]+", one))
    return bad


@dataclass
class Suspect:
    begin: int
    parent: int
    name: str
    end: int = -1
    closed: bool = False
    own: int = 0  # words outside of suspects within
    out: bool = False


@dataclass
class Page:
    """``kinds`` ("" for text, else a tag's name), ``texts`` and ``words`` of the tokens; ``linked`` text; suspects; [begin, end) of outermost landmarks."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    suspects: list[Suspect] = field(default_factory=list)
    landmarks: list[tuple[int, int, bool]] = field(default_factory=list)

    def add(self, kind: str, text: str = "", words: int = 0, linked: bool = False) -> None:
        self.kinds.append(kind), self.texts.append(text), self.words.append(words), self.linked.append(linked)


def _tokens(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(name, whether it closes, attributes, text) of every tag and run of text. A failed look for a tag's end is made once: what follows is read leniently."""
    at, n = 0, len(html)
    last = html.rfind(">")
    tag = TAG
    while at < n:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            yield "", False, "", html[at:]
            return
        if begin > at:
            yield "", False, "", html[at:begin]
        m = RAW.match(html, begin)
        if m:
            yield m[1].lower(), False, "/", ""
            at = m.end()
            continue
        m = tag.match(html, begin)
        if m is None and tag is TAG and html[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
            tag = LENIENT
            m = tag.match(html, begin)
        if m:
            yield m[2].lower(), bool(m[1]), m[3], ""
            at = m.end()
            continue
        m = OTHER.match(html, begin)
        if m is None:
            yield "", False, "", "<"
        at = m.end() if m else begin + 1


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # an open element, and its number as a suspect
    count: dict[str, int] = defaultdict(int)
    marks: list[int] = []
    current, clean, links = -1, 0, 0

    def close(explicit: bool) -> None:
        nonlocal current, links
        name, number = stack.pop()
        count[name] -= 1
        if name == "a":
            links -= 1
        if number >= 0:
            s = page.suspects[number]
            s.end, s.closed, current = len(page.kinds), explicit, s.parent
        if name in LANDMARKS and marks and not count["article"] + count["main"]:
            page.landmarks.append((marks.pop(), len(page.kinds), current < 0))

    for name, closes, attrs, text in _tokens(html):
        if not name:
            text = entities.unescape(text)
            n = len(text.split())
            page.add(WORD, text, n, links > 0)
            if current >= 0:
                page.suspects[current].own += 0 if links else n
            else:
                clean += 0 if links else n
            continue
        if closes:
            if count[name]:
                while stack[-1][0] != name:
                    close(False)
                page.add(f"/{name}")
                close(True)
            else:
                page.add(f"/{name}")
            continue
        if name in BLOCKS and count["p"] and any(x[0] == "p" for x in stack[-DEEP:]) and stack[-1][0] not in ("button",):
            while stack[-1][0] != "p":
                close(False)
            close(False)
        elif name in ENDS:
            names, stop = ENDS[name]
            for k in range(len(stack) - 1, max(-1, len(stack) - DEEP), -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in names.split():
                    while len(stack) > k:
                        close(False)
                    break
        if name in VOID or attrs.endswith("/"):
            page.add(name)
            continue
        number = -1
        if _suspect(name, attrs, count["article"] + count["main"] > 0):
            number = len(page.suspects)
            page.suspects.append(Suspect(len(page.kinds), current, name))
            current = number
        page.add(name)
        if name in LANDMARKS and not count["article"] + count["main"]:
            marks.append(len(page.kinds))
        if name == "a":
            links += 1
        stack.append((name, number))
        count[name] += 1
    while stack:
        close(False)
    _judge(page, clean)
    return page


def _judge(page: Page, clean: int) -> None:
    """Which suspects are left out, from the outermost in. A suspect that is not gives its own words to those that content is measured by."""
    total = [0, *accumulate(page.words)]
    named = [m for m in page.landmarks if total[m[1]] > total[m[0]]]
    named = [m for m in named if m[2]] or named  # those in suspects count only where there is no other
    page.landmarks = named
    for s in page.suspects:
        inside = total[s.end] - total[s.begin]
        if s.parent >= 0 and page.suspects[s.parent].out:
            s.out = True
        elif any(s.begin < b and e <= s.end for b, e, _ in named):
            s.out = False
        elif named and not any(b <= s.begin < e for b, e, _ in named):
            s.out = True
        else:
            whole = inside >= WHOLE or not s.closed or s.name == "form"
            s.out = not (whole and clean < REST * inside)
        if not s.out:
            clean += s.own


def _left_out(page: Page) -> list[bool]:
    out = [False] * len(page.kinds)
    at = 0
    for s in page.suspects:
        if s.out:
            for i in range(max(at, s.begin), s.end):
                out[i] = True
            at = max(at, s.end)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the greatest sum; the first of equals, empty if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def _weighed(page: Page, out: list[bool]) -> list[str]:
    """The kind by which each token is weighed."""
    return [LEFT_OUT if o else LINKED if w and k else kind for kind, w, k, o in zip(page.kinds, page.words, page.linked, out, strict=True)]


def _scores(page: Page, kinds: list[str], weights: dict[str, float], border: float) -> list[float]:
    other = weights["?"]
    tags = frozenset((WORD, LINKED, LEFT_OUT))
    got = [weights[k] * n if k in tags else 0.0 if k.lstrip("/") in LANDMARKS else weights.get(k, other) for k, n in zip(kinds, page.words, strict=True)]
    for b, e, _ in page.landmarks:
        got[b - 1] -= border
        got[e - 1] -= border
    if page.landmarks:  # one region: borders between two of them cost nothing
        for (_, e, _), (b, _, _) in zip(page.landmarks[:-1], page.landmarks[1:], strict=True):
            got[e - 1] += border
            got[b - 1] += border
    return got


def fit(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights from labelled pages, by their other tags; words stay positive and tags negative. Pages without a label are passed over."""
    weights: dict[str, float] = defaultdict(lambda: FIRST["?"], FIRST | {f"/{k}": w for k, w in FIRST.items() if k.isalpha()})
    seen = []
    for page in map(parse, pages):
        if page.landmarks:
            seen.append((page, _weighed(page, _left_out(page)), page.landmarks[0][0], page.landmarks[-1][1] - 1))
    for k in range(epochs):
        wrong = 0
        for page, kinds, a, b in seen:
            s, e = best_run(_scores(page, kinds, weights, 0.0))
            text = lambda lo, hi: any(n and kind != LEFT_OUT for n, kind in zip(page.words[lo:hi], kinds[lo:hi], strict=True))  # noqa: E731, B023
            # runs that differ by tokens without text are the same text
            if text(min(s, a), max(s, a)) or text(min(e, b), max(e, b)):
                wrong += 1
                rate = 4.0 / (1 + k)
                for i, kind in enumerate(kinds):
                    gold, got = a <= i < b, s <= i < e
                    if gold != got and kind not in (WORD, LEFT_OUT):
                        weights[kind] = min(weights[kind] + (rate if gold else -rate), -0.01)
        if not wrong:
            break
    return dict(weights)


def text_of(html: str, weights: dict[str, float]) -> str:
    page = parse(html)
    out = _left_out(page)
    start, end = best_run(_scores(page, _weighed(page, out), weights, BORDER))
    if page.landmarks and page.landmarks[0][0] <= start and end <= page.landmarks[-1][1]:
        start, end = page.landmarks[0][0], page.landmarks[-1][1]
    else:  # whole blocks
        inside = lambda i: page.kinds[i].lstrip("/") in INLINE or page.kinds[i] == WORD
        while start < end and start > 0 and inside(start - 1):
            start -= 1
        while start < end < len(out) and inside(end):
            end += 1
    blocks: list[str] = []
    part: list[str] = []
    for i in range(start, end + 1):
        kind = page.kinds[i] if i < end else "/"
        if not kind:
            if not out[i]:
                part.append(page.texts[i])
        elif kind == "br":
            part.append(" ")
        elif kind.lstrip("/") not in INLINE:
            block = SPACE.sub(" ", "".join(part)).strip()
            if block:
                blocks.append(block)
            part = []
    return "\n".join(blocks)


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights fitted to at most ``labelled`` pages of at most LONGEST characters whose markup names their content."""
    named = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") <= LONGEST)).select("html", F.xxhash64("url", "html").alias("h"))
    # hashes first, then the pages they name: no task sends more than what is used
    least = named.select("h").distinct().orderBy("h").limit(labelled).agg(F.max("h")).first()[0]
    if least is None:
        return fit([])
    some = named.where(F.col("h") <= least).dropDuplicates(["h"]).limit(labelled)
    return fit([r["html"] for r in sorted(some.collect(), key=lambda r: r["h"])])


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    if weights is None:
        weights = learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                text = [text_of(h.as_py() or "", weights) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
