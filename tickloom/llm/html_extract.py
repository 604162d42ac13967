"""Main text of HTML pages by a linear-chain conditional random field.

A tolerant scanner cuts a page into leaf blocks: runs of text between block-level
tags, with the tags and the class, id and role words of the elements around them.
Each block gets features of its ancestors and of its text (length, share of link
text, punctuation, words that mark notices). A two-label linear-chain CRF scores
blocks and neighbouring labels, and Viterbi decoding picks the blocks of the
article.

The CRF is trained here, by gradient ascent on the log-likelihood, on labelled
pages that ``labelled_pages`` makes from a seed: ``n_pages`` pages with known
blocks, in varied layouts. The weights are a few hundred numbers, so tasks
get them with the function.

Defined results: a null or empty page, and one without an article, has an empty
text; markup that breaks off is read as far as it goes; text in ``math`` and
``object`` is page text, that in scripts, styles, drawings and frames is not; an empty table gives no
rows; repeated pages are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block, tags without content, tags whose content is not page text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg title".split())
TO_THE_END = frozenset("script style".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head"}
SAME_CLOSE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main aside nav header footer form body".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
MARKS = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
NOTICE = re.compile(r"cookie|consent|subscribe|newsletter|sign up|log ?in|all rights reserved|copyright|©|privacy|terms of|advert|sponsor|share this|read more|related|comment|reply|posted by", re.I)


#: Fixed values for the made pages: words of texts, and class words of what isn't an article and what is.
PLAIN = "the of and to in that it was for on with as by at from this have not are which city river house music water paper green letter market winter garden train light story village science".split()
OUTSIDE = {
    "nav": ("nav navbar menu navigation breadcrumb breadcrumbs topnav", "Home|About us|Contact|News|Sports|Archive|Products|Help"),
    "header": ("header masthead topbar banner site", "Daily Herald|Your source for news|Log in|Search|Sign up"),
    "aside": ("sidebar widget aside related recommended popular trending rail", "Most read|Related stories|You may also like|Trending now|Tags"),
    "ad": ("ad ads advert advertisement banner promo sponsor sponsored", "Advertisement|Buy now and save 20%|Sponsored content|Limited offer, order today"),
    "notice": ("cookie consent notice alert popup modal gdpr overlay", "We use cookies to improve your experience.|Accept all|By using this site you agree to our privacy policy.|Subscribe to keep reading."),
    "form": ("form search login signup newsletter subscribe", "Subscribe to our newsletter|Your email|Search|Submit|Sign up"),
    "comments": ("comments comment respond replies discussion disqus thread", "Great article, thanks!|I don't agree with this at all.|Reply|3 comments|Leave a comment|Posted by anna on Monday"),
    "share": ("share social sharing follow pagination pager tags meta", "Share this|Tweet|Facebook|Next page|Previous|Print"),
    "footer": ("footer copyright legal bottom colophon", "© 2021 Example Media. All rights reserved.|Privacy policy|Terms of use|Imprint"),
}
INSIDE = "content article post entry story body text main page single".split()
OUTSIDE_WORDS = frozenset(w for words, _ in OUTSIDE.values() for w in words.split()) - {"header", "site", "meta"}


@lru_cache(maxsize=20_000)
def tag_features(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element says to the blocks inside it."""
    if not attributes:
        return (f"in:{tag}",)
    words = {w for m in MARKS.finditer(attributes) for w in WORD.findall(m[2].lower()) if len(w) > 1}
    out = [f"in:{tag}", *[f"mark:{w}" for w in sorted(words)]]
    if words & OUTSIDE_WORDS:
        out.append("outside word")
    if HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(out)


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], int, str]]:
    """(text, features of all ancestors, characters in links, tag) of each leaf block of the body."""
    stack: list[tuple[str, tuple[str, ...]]] = [("#", ())]
    parts: list[str] = []
    linked = 0
    in_link = False
    at, n = 0, len(page)

    def taken() -> tuple[str, tuple[str, ...], int, str] | None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        text = SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
        link, linked = linked, 0
        return (text, stack[-1][1], link, stack[-1][0]) if text else None

    def pop_to(i: int) -> None:
        del stack[i:]

    while at < n:
        lt = page.find("<", at)
        if lt == -1:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end == -1 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end == -1 else end + 1
            continue
        found = TAG.match(page, lt)
        if not found:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):  # the tag breaks off
                end = page.find(">", lt)
                at = n if end == -1 else end + 1
            else:
                parts.append("<")
                at = lt + 1
            continue
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        tag = tag.lower()
        if tag in RAW_TAGS and not closing:
            parts.append(" ")
            if tag == "svg" and attributes.rstrip().endswith("/"):
                continue
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            if end or tag in TO_THE_END:  # of the others, one that is never closed is only a tag
                at = end.end() if end else n
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        if block := taken():
            yield block
        in_link = False
        names = [t for t, _ in stack]
        if closing:
            if tag in names:
                pop_to(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in CLOSES_P and names[-1] == "p":
            pop_to(len(names) - 1)
        elif tag in SAME_CLOSE:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in SAME_CLOSE[tag]:
                    pop_to(i)
                    break
                if names[i] in SCOPE:
                    break
        if tag not in VOID_TAGS:
            above = stack[-1][1]
            own = tag_features(tag, attributes)
            new = tuple(f for f in (*own, f"{stack[-1][0]}>{tag}") if f not in above)
            stack.append((tag, above + new))
    if block := taken():
        yield block


def text_features(text: str, linked: int, tag: str) -> list[str]:
    words = text.count(" ") + 1
    share = linked / len(text)
    out = ["bias", f"tag={tag}", f"words={min(7, int(math.log2(words)))}", f"linked={min(4, int(share * 4))}"]
    if text[-1] in ".!?…\"”":
        out.append("ends")
    if text.count(",") + text.count(".") > 2:
        out.append("marks")
    if words < 12 and NOTICE.search(text):
        out.append("short notice")
    return out


class Chain:
    """weights: feature to score of label 1 against 0. moves[a][b]: label a, then b. first: label 1 at the start."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.first = 0.0
        self.ancestors: dict[tuple[str, ...], float] = {}

    def emission(self, block: tuple[str, tuple[str, ...], int, str]) -> float:
        text, above, linked, tag = block
        get = self.weights.get
        known = self.ancestors.get(above)
        if known is None:
            if len(self.ancestors) > 50_000:
                self.ancestors.clear()
            known = self.ancestors[above] = sum(get(f, 0.0) for f in above)
        return known + sum(get(f, 0.0) for f in text_features(text, linked, tag))

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        if not scores:
            return []
        m, back = self.moves, []
        zero, one = 0.0, self.first + scores[0]
        for s in scores[1:]:
            a, b = zero + m[0][0], one + m[1][0]
            c, d = zero + m[0][1], one + m[1][1]
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + s
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def step(self, page: list[list[str]], labels: list[int], rate: float, squares: dict, ridge: float) -> None:
        """One ascent step on a page's log-likelihood: forward-backward, then AdaGrad."""
        n, m = len(page), self.moves
        scores = [sum(self.weights.get(f, 0.0) for f in fs) for fs in page]

        def add(a: float, b: float) -> float:
            top = max(a, b)
            return top + math.log(math.exp(a - top) + math.exp(b - top))

        forward = [(0.0, self.first + scores[0])]
        for s in scores[1:]:
            z, o = forward[-1]
            forward.append((add(z + m[0][0], o + m[1][0]), add(z + m[0][1], o + m[1][1]) + s))
        backward = [(0.0, 0.0)]
        for s in reversed(scores[1:]):
            z, o = backward[-1]
            backward.append((add(m[0][0] + z, m[0][1] + s + o), add(m[1][0] + z, m[1][1] + s + o)))
        backward.reverse()
        total = add(*forward[-1])
        gradient: dict = {}
        for t in range(n):
            p = math.exp(forward[t][1] + backward[t][1] - total)
            for f in page[t]:
                gradient[f] = gradient.get(f, 0.0) + labels[t] - p
            if not t:
                gradient["first", 1] = labels[0] - p
            else:
                for a in (0, 1):
                    for b in (0, 1):
                        q = math.exp(forward[t - 1][a] + m[a][b] + b * scores[t] + backward[t][b] - total)
                        gradient[a, b] = gradient.get((a, b), 0.0) + ((labels[t - 1], labels[t]) == (a, b)) - q
        for f, g in gradient.items():
            squares[f] = squares.get(f, 1e-6) + g * g
            move = rate * g / math.sqrt(squares[f])
            if isinstance(f, str):
                self.weights[f] = self.weights.get(f, 0.0) * (1 - ridge) + move
            elif f[0] == "first":
                self.first += move
            else:
                m[f[0]][f[1]] += move


def labelled_pages(n_pages: int, seed: int) -> Iterator[tuple[list[tuple], list[int]]]:
    """Blocks and labels of made pages; the label is carried by a mark that is cut off again."""
    rng = random.Random(seed)

    def sentence(low: int = 4, high: int = 24) -> str:
        words = [rng.choice(PLAIN) for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))

    def outside(kind: str) -> str:
        marks, texts = OUTSIDE[kind]
        words = rng.sample(marks.split(), 2)
        attribute = rng.choice([f' class="{words[0]}"', f' class="{words[0]} {words[1]}"', f' id="{words[0]}"', f' class="{words[0]}-{rng.choice(["box", "wrap", "list", "1"])}"', ""])
        tag = kind if kind in ("nav", "header", "aside", "footer", "form") and rng.random() < 0.75 else rng.choice(["div", "section", "div"])
        if tag in ("div", "section") and not attribute:
            attribute = f' class="{words[0]}"'
        texts = rng.choices(texts.split("|"), k=rng.randint(1, 6))
        if kind in ("comments", "aside", "ad", "header", "footer", "notice") and rng.random() < 0.6:
            texts += [paragraph() for _ in range(rng.randint(1, 3))]
        style = rng.random()
        if kind in ("nav", "share", "aside", "footer") and style < 0.6:
            inner = "<ul>" + "".join(f'<li><a href="#">{t}</a></li>' for t in [*texts, *(rng.choice(PLAIN) for _ in range(rng.randint(0, 5)))]) + "</ul>"
        else:
            inner = rng.choice(["", f"<h3>{texts[0]}</h3>"]) + "".join(rng.choice([f"<p>{t}</p>", f"<div>{t}</div>", f"<p><a href='#'>{t}</a></p>"]) for t in texts) if style < 0.9 else rng.choice(texts)
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def inside() -> str:
        out = [f"<h1>\x02{sentence(3, 10)}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.3:
            out = [rng.choice(["<header>", '<header class="entry-header">', '<div class="post-header">', '<div class="site-title">']) + out[0] + "</header>"]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.6:
                out.append(f"<p>\x02{paragraph()}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.68:
                out.append(f"<{(h := rng.choice(['h2', 'h3']))}>\x02{sentence(2, 8)}</{h}>")
            elif kind < 0.74:
                out.append(rng.choice(["<ul>", "<ol>", '<ul class="list">']) + "".join(f"<li>\x02{sentence(1, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.8:
                out.append(f"<blockquote>\x02{paragraph()}</blockquote>")
            elif kind < 0.84:
                out.append(f"<div>\x02{paragraph()}</div>")
            elif kind < 0.87:
                out.append("<p><b>\x02" + sentence(3, 10) + "<br>")
            else:
                out.append(outside(rng.choice(["ad", "ad", "share", "aside", "notice", "form"])))
        return "".join(out)

    for _ in range(n_pages):
        before = [outside(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        after = [outside(k) for k in ("share", "aside", "comments", "ad", "form", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        words = rng.sample(INSIDE, 2)
        opened, closed = rng.choice(
            [("<article>", "</article>"), (f'<article class="{words[0]}">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{words[0]}">', "</div>"), (f'<div id="{words[0]}"><div class="{words[1]}-{words[0]}">', "</div></div>"), (f'<section class="{words[0]}">', "</section>")]
        )
        page = f"<html><head><title>x</title></head><body>{''.join(before)}{opened}{inside()}{closed}{''.join(after)}</body></html>"
        found = list(blocks(page))
        labels = [int("\x02" in b[0]) for b in found]
        cleaned = [(b[0].replace("\x02", ""), b[1], b[2], b[3]) for b in found]
        kept = [i for i, b in enumerate(cleaned) if b[0]]
        if kept:
            yield [cleaned[i] for i in kept], [labels[i] for i in kept]


@lru_cache(maxsize=4)
def trained(n_pages: int = 600, epochs: int = 12, seed: int = 7) -> Chain:
    chain, squares = Chain(), {}
    pages = [([[*b[1], *text_features(b[0], b[2], b[3])] for b in found], labels) for found, labels in labelled_pages(n_pages, seed)]
    order, rng = list(range(len(pages))), random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(order)
        for i in order:
            chain.step(*pages[i], 0.4 / (1 + 0.3 * epoch), squares, 1e-5)
    return chain


def main_text(chain: Chain, page: str) -> str:
    found = list(blocks(page))
    labels = chain.decode([chain.emission(b) for b in found])
    return "\n\n".join(b[0] for b, label in zip(found, labels, strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(chain, p or "") for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
