"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

Elements that never hold the article (scripts, menus, adverts, forms, reader comments and
so on) are passed over: those of such a kind, and those with a class or id that says nothing
else, like "ad-slot" or "site-footer". A class that also says something else, like "social-history",
is only evidence. In what is left every word has a score by where it stands (inside an article, in
a paragraph, in a link, under such a class) and every tag a negative one; the contiguous run
with the greatest sum is the content. Scores are log-odds counted on labelled pages of several layouts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import typed

#: Elements whose content is raw text up to their end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title")}
#: Elements passed over with all that is in them.
_UNSEEN = frozenset("noscript template svg math iframe object canvas audio video select button datalist head".split())
_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in _UNSEEN}
#: An article in one of these is passed over too.
_SEALED = _UNSEEN - {"select", "button", "datalist", "head"}
_IN_HEAD = frozenset("head base basefont bgsound link meta noscript script style template title noframes".split())
_TEXT = re.compile("[^<]*")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<bad>{'|'.join([*_RAW, *sorted(_UNSEEN)])})(?=[\s/>])[^>]*>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: One attribute with its value, so that nothing is looked for inside values or longer names.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = frozenset("class id role hidden aria-hidden".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))
_PASSED = frozenset("nav footer aside form menu dialog search fieldset dir".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of a class or id that name what isn't the article.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist respond disqus replies reply
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation
    sidebar sidebars widget widgets footer masthead promo promotion promoted sponsor sponsored sponsorship related recommended share sharing social skip toolbar
    topbar pagination pager paging tags outbrain taboola paywall toc""".split()
)
#: Words that stand beside those in one class or id and say nothing else.
_BESIDE = frozenset(
    """area bar block body bottom box btn button buttons card col column container content desktop fixed global group header head heading icon icons inline inner item items label left link links list
    main mobile page panel post posts primary right row secondary section site slot small sticky story stories text title top unit wrap wrapper""".split()
)
#: Beside one of these, such a name tells how a page is laid out.
_LAYOUT = frozenset("layout with has no grid".split())
_COMMENTS = frozenset("comment comments commentlist respond disqus replies reply".split())


@lru_cache(20_000)
def _token(token: str) -> tuple[frozenset[str], bool]:
    """Of one class or id: its parts that name what isn't the article, if it says nothing else; and whether it has such parts beside others."""
    parts = {x for x in re.split(r"[_\-]+", token) if x}
    named = parts & _NAMES
    if not named or parts & _LAYOUT:
        return frozenset(), False
    if all(x in _BESIDE or x.isdigit() for x in parts - named):
        return named, False
    return frozenset(), True


@lru_cache(20_000)
def _names(attrs: str) -> tuple[frozenset[str], bool, bool]:
    """What class, id and role name that isn't the article; whether the element is hidden; whether a class is evidence only."""
    found, hidden, weak = set(), False, False
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key not in _TELLING:
            continue
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "role":
            found.update("role:" + v for v in value.split() if v in _ROLES)
        else:
            for token in value.split():
                named, other = _token(token)
                found |= named
                weak |= other
            if _LAYOUT.intersection(value.split()):
                found = {x for x in found if x.startswith("role:")}
    return frozenset(found), hidden, weak


def _next(known: dict[str, int], name: str, pattern: re.Pattern, source: str, pos: int) -> int:
    """Where the first match of ``pattern`` from pos on begins, -1 if there is none; looked for once for each place."""
    if name not in known or 0 <= known[name] < pos:
        m = pattern.search(source, pos)
        known[name] = m.start() if m else -1
    return known[name]


#: What a new element ends that was left open, by the name of the open one, and what hides it from that.
_ENDS = {"p": BLOCKS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_HIDE = ("ul", "ol", "table", "div", "article", "section", "main", "dl", "body", "td")
_KINDS = frozenset("p li blockquote pre td".split())


class _Open:
    """The open elements, with what is asked about them kept up to date: each step takes the same time however many there are."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool, str]] = []  # name, passed over, of reader comments, weakly named, kind of the nearest block
        self.at: dict[str, list[int]] = {}  # places in the stack by name
        self.passed = self.unseen = self.comments = self.sealed = self.main = self.links = self.weak = 0
        self.floor = 0  # below here nothing counts as passed over any more

    def __contains__(self, name: str) -> bool:
        return bool(self.at.get(name))

    @property
    def kind(self) -> str:
        return self.stack[-1][4] if self.stack else "other"

    def _count(self, name: str, passed: bool, comments: bool, weak: bool, by: int, counted: bool) -> None:
        self.comments += by * comments
        self.weak += by * weak
        self.main += by * (name in _MAIN)
        self.links += by * (name == "a")
        if counted:
            self.passed += by * passed
            self.unseen += by * (passed and name in _UNSEEN)
            self.sealed += by * (passed and name in _SEALED)

    def push(self, name: str, passed: bool, comments: bool, weak: bool) -> None:
        kind = self.kind if name not in BLOCKS else "h" if name in _HEADS else name if name in _KINDS else "other"
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, passed, comments, weak, kind))
        self._count(name, passed, comments, weak, 1, True)

    def pop(self) -> str:
        name, passed, comments, weak, _ = self.stack.pop()
        self.at[name].pop()
        self._count(name, passed, comments, weak, -1, len(self.stack) >= self.floor)
        self.floor = min(self.floor, len(self.stack))
        return name

    def end(self, name: str) -> None:
        """Closes the innermost element of this name with all inside it."""
        while self.pop() != name:
            pass

    def begins(self, name: str) -> None:
        """Closes what the begin of such an element ends."""
        for opener, closers in _ENDS.items():
            if name in closers and opener in self:
                at = self.at[opener][-1]
                if not any(x != opener and x in self and self.at[x][-1] > at for x in _HIDE):
                    while len(self.stack) > at:
                        self.pop()

    def seen_again(self) -> None:
        """From here on the elements that are open count as seen."""
        self.floor, self.passed, self.unseen, self.sealed = len(self.stack), 0, 0, 0


class Page:
    """items: ("t", tag) or ("w", place, block number, words) in page order; texts of blocks are joined later. place: (where, kind of block, in a link, weakly named)."""

    def __init__(self, source: str, marks: bool = False):
        self.items: list[tuple] = []
        self.labels: list[bool] = []
        inside_label = False
        open_ = _Open()
        block = 0
        any_main = False
        at_end: dict[str, int] = {}  # where the next end tag of a name is, as far as known
        pos = 0
        while m := _TOKEN.match(source, pos):
            pos = m.end()
            text, name = m["text"], m["name"] or m["bad"]
            # a head without its end tag ends where something begins that can't stand in it
            if open_.stack and open_.stack[-1][0] == "head" and (text.strip() if text is not None else name and not m["close"] and name.lower() not in _IN_HEAD):
                open_.pop()
            if text is not None:
                if not open_.passed:
                    words = entities.unescape(text)
                    self.items.append(("w", ("main" if open_.main else "out", open_.kind, bool(open_.links), bool(open_.weak)), block, words))
                    self.labels.append(inside_label)
                continue
            if name is None:
                if marks and m[0] in ("<!--main-->", "<!--/main-->"):
                    inside_label = m[0] == "<!--main-->"
                continue
            name = name.lower()
            attrs = m["attrs"] or ""
            if name in _RAW:
                if not m["close"] and not (attrs.endswith("/") and ("svg" in open_ or "math" in open_)):
                    end = _next(at_end, name, _RAW[name], source, pos)
                    # only a title is taken to be short if its end tag is missing
                    pos = _RAW[name].match(source, end).end() if end >= 0 else _TEXT.match(source, pos).end() if name == "title" else len(source)
                continue
            if name in _UNSEEN and not m["close"] and name != "head" and _next(at_end, name, _END[name], source, pos) < 0:
                continue
            if name == "br":
                if not open_.passed:
                    self.items.append(("w", None, block, " "))
                    self.labels.append(inside_label)
                continue
            if name in BLOCKS and not open_.unseen:
                block += 1
            if m["close"] or name in ("select", "button"):
                if name in open_:  # a select or button inside another means that one was left open
                    open_.end(name)
            elif not open_.unseen:
                open_.begins(name)
            if not m["close"]:
                names, hidden, weak = _names(attrs) if attrs else (frozenset(), False, False)
                over = hidden or name in _PASSED or name in _UNSEEN or name == "header" and not open_.main or bool(names)
                over = over and name not in ("html", "body")
                if name in _MAIN and open_.passed and not over and not open_.comments and not open_.sealed:
                    # the article isn't part of a menu or advert that was left open
                    open_.seen_again()
                if name not in VOID and not attrs.endswith("/"):
                    open_.push(name, over, over and not names.isdisjoint(_COMMENTS), weak)
                any_main |= name in _MAIN and not open_.passed
            if not open_.passed and name not in _UNSEEN:
                self.items.append(("t", name))
                self.labels.append(inside_label)
        if not any_main:
            self.items = [("w", x[1] and ("none", *x[1][1:]), *x[2:]) if x[0] == "w" else x for x in self.items]


#: Pages with the article between marks; more can be given to fit().
LABELLED = (
    """<html><body><div id="top">Site name <a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div><p>Edition of today</p><article><!--main--><h1>River rises after rain</h1><p>The river rose by two metres
    on Monday after a week of rain, and the lower road was closed.</p><p>Boats were moved <a href="/x">to the old harbour</a> in the night.</p><ul><li>Stay off the bank</li><li>Keep dogs in</li></ul><blockquote>We have not seen this in years, said one of them.</blockquote><!--/main--></article><div>All rights reserved. <a href="/p">Privacy</a> <a href="/t">Terms</a></div></body></html>""",
    """<html><body><div><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></div><div>Latest stories today</div><main><!--main--><h2>How to bake bread</h2><p>Mix flour, water and salt, and leave the dough for a night.</p><div>It should have grown to twice its size by morning.</div><pre>bake at 230 degrees</pre>
    <table><tr><td>Flour</td><td>500 g</td></tr></table><p>Let it cool before you cut it.</p><p><a href="/more">A longer version with pictures</a></p><!--/main--></main><ul><li><a href="/1">Other page</a></li><li><a href="/2">Another page</a></li></ul><p>Written by the staff of the site</p></body></html>""",
    """<html><body><ul><li><a href="/">Start</a></li><li><a href="/k">Catalogue</a></li><li><a href="/h">Help</a></li></ul><div><!--main--><h1>Notes on the moth</h1><p>The moth flies from May to July and rests on bark by day, where it is hard to see.</p>
    <p>Its larva feeds on willow. It winters as a pupa in the soil, close to the roots of the tree.</p><p>Records come from every county but two.</p><blockquote>It came to the lamp in numbers.</blockquote><!--/main--></div><div><a href="/x">Next</a> <a href="/y">Previous</a></div><ul><li><a href="/z">Imprint</a></li></ul></body></html>""",
    """<html><body><table><tr><td><a href="/1">Index</a></td><td><a href="/2">Search</a></td></tr></table><!--main--><h3>Report of the meeting</h3><p>The meeting opened at nine with all members present, and the minutes were read.</p><div>The treasurer spoke of the new roof, which will cost more than was thought.</div>
    <p>It was agreed to ask for three more offers.</p><!--/main--><div><a href="/f">Feedback</a></div></body></html>""",
    """<html><body><div><div><a href="/">Journal</a></div><div><a href="/1">Issues</a> <a href="/2">Authors</a></div></div><div class="social-profiles"><a href="/m">Mail</a> <a href="/r">Feed of posts</a></div><article><!--main--><h1>A mill and its people</h1><div class="social-history"><p>The mill gave work to
    forty families, and its school was open to all of them.</p><p>In the winter of that year the river froze and the wheel stood still.</p></div><h2>After the fire</h2><p>It was built again in brick, <a href="/w">with a wheel of iron</a>.</p><dl><dt>Floors</dt><dd>Five, and a loft</dd></dl><!--/main--></article>
    <div class="related-reading"><a href="/a">Mills of the north</a> <a href="/b">Wheels and weirs</a></div></body></html>""",
    """<html><body><center><a href="/">Up</a> | <a href="/c">Contents</a></center><div class="entry"><!--main--><h3>Fixing a leaking tap</h3><div>Turn the water off first, at the valve below the sink, and open the tap until nothing comes.</div><div>Take off the cap, then the screw under it. The washer is at the bottom of the stem.</div><ol><li>Pull the old washer out.</li><li>Clean the seat with a cloth.</li>
    <li>Press the new one in by hand.</li></ol><pre>washer 12 mm, stem M20</pre><div>If it still drips, the seat is worn and must be ground.</div><!--/main--></div><div><a href="/n">Next tip</a></div><div>Tips are given without any promise. <a href="/l">Legal</a></div></body></html>""",
    """<html><body><div class="menu-of-the-day"><a href="/soup">Soup</a> <a href="/fish">Fish</a></div><main><!--main--><h1>Notice of the meeting</h1><section class="notice-of-meeting"><p>All members are asked to come to the hall at six, as the vote on the new rules can't be put off.</p><p>Whoever can't come may write to the chair by Friday.</p></section>
    <table><tr><th>Item</th><th>Speaker</th></tr><tr><td>Accounts</td><td>The treasurer</td></tr></table><blockquote>We need every voice, said the chair.</blockquote><!--/main--></main><div class="share-this-story"><a href="/s1">Send</a> <a href="/s2">Print</a></div><p>Page made in May</p></body></html>""",
    """<html><body><ul><li><a href="/1">Forum</a><li><a href="/2">Rules</a></ul><div><div><div><!--main--><h1>Walking the ridge in one day</h1>It took us eleven hours from the car park to the hut, with two long stops.<p>Start before sunrise: there is no water after the second spring, and the last ladder lies in full sun.<p>We met nobody until noon.<!--/main--></div></div></div>
    <div class="comment-policy-page"><a href="/p">How we moderate</a></div><div><a href="/top">Back up</a></div></body></html>""",
)


def _count(item: tuple) -> int:
    return len(item[3].split())


def _backoff(place: tuple) -> tuple[tuple, ...]:
    """The place, and wider ones to go by where it wasn't seen."""
    where, _, link, weak = place
    return place, (where, "", link, weak), (where, "", None, weak), (where, "", link, None), (where, "", None, None)


@lru_cache(4)
def fit(pages: tuple[str, ...] = LABELLED) -> tuple[dict, dict]:
    """Scores of words by place, and of tags (never above -0.02), from pages with marks."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for source in pages:
        page = Page(source, marks=True)
        for item, inside in zip(page.items, page.labels):
            if item[0] == "t":
                tags[inside][item[1]] += 1
            elif item[1]:
                n = _count(item)
                for place in _backoff(item[1]):
                    words[inside][place] += n
    odds = lambda c, k: math.log((c[True][k] + 0.5) / (c[False][k] + 0.5))
    scores = {k: max(-3.0, min(3.0, odds(words, k))) for k in {*words[True], *words[False]}}
    return scores, {k: max(-0.3, min(-0.02, odds(tags, k) / 10)) for k in {*tags[True], *tags[False]}}


def scored(items: list[tuple], weights: tuple[dict, dict]) -> list[float]:
    """What each item adds to the sum of a region."""
    scores, tags = weights
    out = []
    for item in items:
        if item[0] == "t":
            out.append(tags.get(item[1], -0.05))
        elif item[1]:
            out.append(next((scores[k] for k in _backoff(item[1]) if k in scores), 0.0) * _count(item))
        else:
            out.append(0.0)
    return out


def region(values: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run with the greatest sum, (0, 0) if none is above 0; found in one pass."""
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(source: str | None, weights: tuple[dict, dict] | None = None) -> str:
    """Blocks of the best region, joined by two newlines; empty if no word scores above 0."""
    if not source:
        return ""
    items = Page(source).items
    begin, end = region(scored(items, weights or fit()))
    out: dict[int, list[str]] = {}
    for item in items[begin:end]:
        if item[0] == "w":
            out.setdefault(item[2], []).append(item[3])
    blocks = (" ".join("".join(x).split()) for x in out.values())
    return "\n\n".join(x for x in blocks if x)


def _extract(weights: tuple[dict, dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            texts = [extract(x, weights) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, labelled: Iterable[str] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    Null or empty html, and pages without content, give an empty text. Other columns are
    ignored, repeated rows kept. An empty table gives an empty result.
    """
    rows = typed(pages, page_id="long", url="string", html="string")
    return rows.mapInArrow(partial(_extract, fit(tuple(labelled))), "page_id long, url string, text string, n_chars long")
