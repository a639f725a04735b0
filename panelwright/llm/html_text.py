"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score by their surroundings
(block tag, link or not, inside or outside the page's own ``article`` or
``main``), tags score negative; one linear scan (running sum, restarted when it
falls below zero) finds the contiguous region of the greatest sum.  Weights
are log-odds counted on labelled pages: pages whose own mark-up names the
article, of which a bounded sample is read.  Unseen surroundings fall back on
prior counts.

What is no article text wherever it stands (menus, adverts, forms, notices,
comments, …) is taken out before the scan, so it costs a region nothing: an
advert does not cut the article around it.  Containers are known by their tag
and by the words of their class, id and role, of which any such word decides
(``comment-body`` is a comment); for names outside the fixed lists the labelled
pages decide: names that hold words outside articles only.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, store, text_or_empty

SAMPLE_PAGES = 4_000

# --- fixed values: HTML vocabulary -------------------------------------------
BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option
p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
LABEL_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("""article aside body button dialog div fieldset figure footer form header html label li main menu nav
ol section select span summary table td th tr ul""".split())
TAG_KIND = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
            "button": "form", "select": "form", "label": "form", "fieldset": "form", "dialog": "notice", "head": "header"}
WORD_KIND = {
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc share sharing social".split(), "menu"),
    **dict.fromkeys("header masthead topbar toolbar logo meta byline".split(), "header"),
    **dict.fromkeys("footer foot copyright colophon contentinfo".split(), "footer"),
    **dict.fromkeys("sidebar aside rail related recommended complementary".split(), "sidebar"),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion".split(), "advert"),
    **dict.fromkeys("cookie cookies consent gdpr notice notices popup modal overlay dialog newsletter subscribe".split(), "notice"),
    **dict.fromkeys("form search login signup".split(), "form"),
    **dict.fromkeys("comment comments disqus replies reply respond discussion".split(), "comments"),
}
# usually no article text, unless the labelled pages say otherwise
LEAN_NAMES = frozenset("tabs banner legal widget alert".split())
CONTENT_WORDS = frozenset("article content main story post entry body text".split())
LAYOUT_WORDS = frozenset("wrap wrapper container layout page site grid row".split())
# classes that say something about their element, not what it is: category-ads, no-sidebar
SAYING = frozenset("category tag type status format has no not with without is hide show".split())
ROLE_ATTRIBUTES = ("class", "id", "role", "aria-label")
# -----------------------------------------------------------------------------

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|
    <(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?P<end>>|\Z)|
    (?P<text>[^<]+|<)""", re.S | re.X)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/?$)|display\s*:\s*none", re.I)


def container_names(attrs: str) -> tuple[set[str], set[str]]:
    """Words in the names of a container, and its whole classes."""
    words, whole = set(), set()
    for name, value in _ATTR.findall(attrs):
        if name.lower() in ROLE_ATTRIBUTES:
            for one in value.strip("\"'").split():
                parts = [x.lower() for x in _PART.findall(one)]
                whole.add(one.lower())
                if not (len(parts) > 1 and parts[0] in SAYING):
                    words.update(x for i, x in enumerate(parts) if i == 0 or parts[i - 1] not in SAYING)
    return words, whole


def container_kind(tag: str, attrs: str, inside: bool = False, lean=LEAN_NAMES) -> str:
    """Kind of a container that holds no article text, or "".  ``inside``: it
    stands in an article, where headers are part of the text."""
    hidden = _HIDDEN.search(re.sub(r"""(?<!style=)("[^"]*"|'[^']*')""", "", attrs)) or re.search(r"""aria-hidden\s*=\s*["']?true""", attrs, re.I)
    if hidden:
        return "notice"
    words, whole = container_names(attrs)
    if tag in LABEL_TAGS:                         # an article of that kind itself, as each reader comment may be
        return next((WORD_KIND[n] for n in sorted(whole) if n in WORD_KIND), "comments" if words & {"comment", "comments", "reply"} else "")
    if tag in ("html", "body") or words & LAYOUT_WORDS and words & CONTENT_WORDS:
        return ""
    if tag in TAG_KIND and not (inside and tag == "header"):
        return TAG_KIND[tag]
    kinds = {WORD_KIND[n] for n in words if n in WORD_KIND}
    if inside or words & CONTENT_WORDS - {"main"}:
        kinds.discard("header") if not words & {"meta", "byline"} else None
    return min(kinds) if kinds else "learned" if words & lean and not inside else ""


class _Page:
    """Entries of a page in order, ``(what, value, block, link, container)``,
    and its containers, ``[parent, kind, is label, names]``."""

    def __init__(self, page: str, lean):
        self.entries, self.containers = [], [[-1, "", False, ()]]
        stack = [("", 0)]                             # tag, container
        block, link, at = "body", False, 0
        while at < len(page):
            m = _TOKEN.match(page, at)
            if m is None:                             # a quote that never ends: skip its tag's "<"
                at += 1
                continue
            at = m.end()
            tag = (m["tag"] or "").lower()
            if m["text"] is not None:
                self.entries.append(("words", m["text"], block, link, stack[-1][1]))
            elif not tag or not m["end"]:
                continue
            elif m["close"]:
                if tag == "a":
                    link = False
                self.entries.append(("tag", tag, block, link, stack[-1][1]))
                if any(t == tag for t, _ in stack[1:]):
                    while stack.pop()[0] != tag:
                        pass
                if tag in BLOCK_TAGS:
                    block, link = "body", False
            elif tag in RAW_TAGS and not m["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                if tag in BLOCK_TAGS:
                    block, link = tag, False
                if tag in LABEL_TAGS:                 # an article does not start inside an unclosed generic container
                    while stack[-1][0] in ("span", "p"):
                        stack.pop()
                if tag == "a":
                    link = True
                elif tag in CONTAINERS and tag not in VOID_TAGS and not m["attrs"].rstrip().endswith("/"):
                    self._open(tag, m["attrs"], stack, lean)
                self.entries.append(("tag", tag, block, link, stack[-1][1]))
        self.inside, self.out = [False], [False]
        for parent, kind, label, _ in self.containers[1:]:
            self.out.append(self.out[parent] or bool(kind))
            self.inside.append(self.inside[parent] or label)

    def _open(self, tag, attrs, stack, lean):
        above = stack[-1][1]
        inside, x = False, above
        while x > 0:
            inside |= self.containers[x][2]
            x = self.containers[x][0]
        kind = container_kind(tag, attrs, inside, lean)
        if tag in LABEL_TAGS and not kind:            # what holds the article is no menu, header, notice or form
            for t, c in stack[1:]:
                if t not in ("nav", "aside", "footer") and (tag == "main" or self.containers[c][1] in ("menu", "header", "notice", "form", "learned")):
                    self.containers[c][1] = ""
        names = container_names(attrs)[0] if not kind else ()
        self.containers.append([above, kind, tag in LABEL_TAGS and not kind, names])
        stack.append((tag, len(self.containers) - 1))


def tokens(page: str, lean=LEAN_NAMES):
    """What the scan sees, in order: ``("tag", name, None, in article)``,
    ``("words", text, (block tag, in link, mark), in article)`` and, for each
    stretch taken out, ``("gap", "", None, in article)``.  The mark is "in" or
    "out" of the page's own article, "" on a page without one.  Mark-up errors
    are tolerated: unclosed tags end with their parent, an unfinished tag at
    the end is dropped, unknown end tags are ignored."""
    p = _Page(page, lean)
    labelled = any(inside and not out for inside, out in zip(p.inside, p.out))
    gap = False
    for what, value, block, link, c in p.entries:
        if p.out[c]:
            if not gap:
                yield "gap", "", None, p.inside[c]
            gap = True
            continue
        gap = False
        mark = "" if not labelled else "in" if p.inside[c] else "out"
        yield what, value, (block, link, mark) if what == "words" else None, p.inside[c]


def page_counts(page: str) -> Counter:
    """Words by block tag and link, tags by name and words by container name,
    inside and outside the labelled article; empty for a page without label."""
    p = _Page(page, frozenset())
    if not any(inside and not out for inside, out in zip(p.inside, p.out)):
        return Counter()
    out = Counter()
    for what, value, block, link, c in p.entries:
        if p.out[c]:
            continue
        inside = p.inside[c]
        n = len(value.split()) if what == "words" else 0
        if n:
            out["word", f"{block}|{link}", inside] += n
            while c > 0:
                for name in p.containers[c][3]:
                    out["name", name, inside] += n
                c = p.containers[c][0]
        elif what == "tag":
            out["tag", value if value in BLOCK_TAGS or value in ("a", "b", "i", "em", "strong", "span") else "other", inside] += 1
    return out


class Weights:
    """Scores from counts {(what, key, inside): n}; ``{}`` gives the priors."""

    LABEL = 3.0                                       # what the page's own mark of its article adds

    def __init__(self, counts: dict):
        self.counts = counts
        self.word_cache: dict = {}
        self.tag_cache: dict = {}
        total = {side: max(1, sum(n for (w, _, s), n in counts.items() if w == "tag" and s is side)) for side in (True, False)}
        self.tag_total = total
        held = {k for w, k, _ in counts if w == "name"}
        self.lean = frozenset({n for n in held | LEAN_NAMES if self._outside(n)})

    def _outside(self, name: str) -> bool:
        """Names that hold next to no words of articles; 100 words must say so."""
        inside, outside = self.counts.get(("name", name, True), 0), self.counts.get(("name", name, False), 0)
        return 50 * inside <= outside + (100 if name in LEAN_NAMES else -100) and (outside >= 100 or name in LEAN_NAMES)

    def word(self, context) -> float:
        if context not in self.word_cache:
            block, link, mark = context
            inside, outside = (1.0, 2.0) if link else (3.0, 1.0)
            key = f"{block}|{link}"
            inside += self.counts.get(("word", key, True), 0)
            outside += self.counts.get(("word", key, False), 0)
            score = max(-3.0, min(3.0, math.log(inside / outside)))
            self.word_cache[context] = max(0.3, score) if mark == "in" else score - 2 * self.LABEL if mark == "out" else score
        return self.word_cache[context]

    def tag(self, name: str) -> float:
        """Negative: between -0.1 for tags found in articles only and -2."""
        if name not in self.tag_cache:
            inside = (self.counts.get(("tag", name, True), 0) + 1) / self.tag_total[True]
            outside = (self.counts.get(("tag", name, False), 0) + 1) / self.tag_total[False]
            self.tag_cache[name] = -max(0.1, min(2.0, math.log1p(outside / inside)))
        return self.tag_cache[name]


def main_text(page: str, weights: Weights) -> str:
    """Text of the best region: blocks in page order, one per line."""
    entries = list(tokens(page, weights.lean))
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    for i, (what, value, context, inside) in enumerate(entries):
        if total <= 0:
            total, start = 0.0, i
        if what == "words":
            total += weights.word(context) * len(value.split())
        elif what == "tag" and not inside:            # inside its own mark an article's tags do not speak against it
            total += weights.tag(value)
        if total > best:
            best, best_from, best_to = total, start, i + 1
    blocks, current = [], []
    for what, value, context, _ in entries[best_from:best_to]:
        if what == "words":
            current.append(value)
        elif what == "gap" or value in BLOCK_TAGS:
            blocks.append(current)
            current = []
    blocks.append(current)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _count_pages(batches):
    for pdf in batches:
        total, pages = Counter(), Counter()
        for page in pdf["html"]:
            found = page_counts(page)
            total.update(found)
            pages.update(k[:2] for k in {(w, k) for w, k, _ in found})
        yield pd.DataFrame([(w, k, s, n, pages[w, k] if not s or (w, k, False) not in total else 0) for (w, k, s), n in total.items()],
                           columns=["what", "key", "inside", "n", "pages"])


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample_pages`` labelled pages, those with the
    smallest hash of their id.  What comes to the driver is one row per tag and
    context, a fixed vocabulary, and per container name that one sampled page
    in a hundred uses: at most a hundred times the names of a page."""
    text = text_or_empty(html_col)
    labelled = (pages.select(F.xxhash64(F.col(id_col)).alias("key"), text.alias("html"))
                .filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")))
    chosen = labelled.select("key").distinct().orderBy("key").limit(sample_pages)
    sample = labelled.join(F.broadcast(chosen), "key", "left_semi").select("html")       # <= sample_pages keys
    counts = store(on_workers(sample).mapInPandas(_count_pages, "what string, key string, inside boolean, n long, pages long")
                   .groupBy("what", "key", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")), "page-weights")
    used = counts.groupBy("what", "key").agg(F.sum("pages").alias("used"))
    most = used.agg(F.max("used")).scalar()
    names = used.where((F.col("what") == "name") & (100 * F.col("used") >= most)).select("what", "key")
    kept = counts.where(F.col("what") != "name").unionByName(counts.join(names, ["what", "key"], "left_semi")).collect()
    return Weights({(r["what"], r["key"], r["inside"]): r["n"] for r in kept})


def extract_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Character references are decoded; white space in a block becomes one
    blank; blocks are joined by a line break.  NULL or empty pages, and pages
    without article text, give the empty text.  NULL and repeated ids are rows
    like others; other columns are ignored; an empty table gives an empty
    result."""
    shared = on_workers(pages).sparkSession.sparkContext.broadcast(weights)

    def extract(texts):
        return pd.Series([main_text(t, shared.value) for t in texts], dtype=object)
    extract.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       F.pandas_udf(extract, "string")(text_or_empty(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
