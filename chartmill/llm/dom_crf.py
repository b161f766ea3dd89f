"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks: stretches of text between the boundaries of
block elements, each with the open elements around it. The field labels every
block as main text or not, from features of the ancestors (tags, and words of
their class, id and role), of the text (length, share of link text, punctuation), and from
the labels of adjacent blocks. Viterbi decoding picks the best labelling of a page.

The weights maximise the likelihood of labelled pages: those of
``labelled_pages``, or given ones.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartmill.llm.common import col, small_batches, text_of

#: Labelled pages the weights are learned from.
TRAINING_PAGES = 500

# Fixed values of HTML: elements that begin a block of their own, have no end tag, or hold no readable text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset(
    "script style noscript template textarea select option button svg iframe object canvas title audio video map datalist".split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
#: Open elements that a new one of the given kind ends, up to the nearest of their containers.
ENDED_BY = {
    "li": ("li", {"ul", "ol", "menu", "dir"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr", {"table"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select"}),
}
_ENDS_P = BLOCK_TAGS - {"option", "optgroup", "caption", "td", "th", "tr", "tbody", "tfoot", "thead", "li", "dd", "dt"} | {"li", "dd", "dt"}
_P_WALL = frozenset("article aside blockquote body div dd dl fieldset figure footer form header li main nav ol section table td th ul button".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>|<[!?][^>]*+>|<(?=/?[A-Za-z!?])[^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+|=")
_NAMING = ("class", "id", "role", "aria-label")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NO_DISPLAY = re.compile(r"(?i)\s*display\s*:\s*none\s*(?:!\s*important\s*)?")
_NAME_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def attributes_of(markup: str) -> dict[str, str]:
    """The attributes of a start tag, names in small letters; of a repeated one the first counts, as in browsers."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(markup):
        if name:
            found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def hides(attributes: dict[str, str]) -> bool:
    """Whether the attributes themselves hide an element; what others say about hiding is text."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = attributes.get("style", "")
    return bool(style) and any(_NO_DISPLAY.fullmatch(part) for part in _CSS_COMMENT.sub(" ", style).split(";"))


@dataclass
class Block:
    """A leaf block: its text, the share of it inside links, and the features of its ancestors."""

    text: str
    link_share: float
    context: tuple[str, ...]


def leaf_blocks(page: str) -> list[Block]:
    """The readable leaf blocks of a page in order; tolerant of unclosed and stray tags and cut-off ends."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, features of it and what is around it, hidden
    parts: list[str] = []
    linked = 0
    length = 0
    context: tuple[str, ...] = ()
    hidden = False
    in_link = 0
    opened: Counter[str] = Counter()  # so that an end tag without its start costs no walk over the stack

    def flush() -> None:
        nonlocal linked, length
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, min(1.0, linked / max(length, 1)), context))
            parts.clear()
        linked = length = 0

    def pop_to(size: int) -> None:
        nonlocal context, hidden, in_link
        if any(tag in BLOCK_TAGS for tag, _, _ in stack[size:]):
            flush()
        in_link -= sum(tag == "a" for tag, _, _ in stack[size:])
        opened.subtract(tag for tag, _, _ in stack[size:])
        del stack[size:]
        context, hidden = (stack[-1][1], stack[-1][2]) if stack else ((), False)

    def add(text: str) -> None:
        nonlocal linked, length
        if not hidden and text:
            parts.append(text)
            size = len(text.strip())
            length += size
            linked += size if in_link else 0

    at = 0
    while True:
        found = _MARKUP.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if found.group(2) is None:
            continue
        tag = found.group(2).lower()
        if found.group(1):
            if not opened[tag]:
                continue
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    pop_to(place)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in ENDED_BY:
                ended, wall = ENDED_BY[tag][0].split(), ENDED_BY[tag][1]
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] in wall:
                        break
                    if stack[place][0] in ended:
                        pop_to(place)
                        break
            elif tag in _ENDS_P:
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] == "p":
                        pop_to(place)
                        break
                    if stack[place][0] in _P_WALL:
                        break
        attributes = found.group(3) or ""
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"(?i)</{tag}\s*>?").search(page, at)
            at = end.end() if end else len(page)
            continue
        names = [f"in {tag}"] if tag in BLOCK_TAGS else []
        given = attributes_of(attributes) if attributes else {}
        if tag in BLOCK_TAGS:
            for name, value in given.items():
                if name in _NAMING:
                    names += [f"name {word}" for word in _NAME_WORD.findall(value.lower())]
        covered = hidden or tag in HIDDEN_TAGS or hides(given)
        inner = context + tuple(name for name in names if name not in context) if names else context
        stack.append((tag, inner, covered))
        opened[tag] += 1
        in_link += tag == "a"
        context, hidden = inner, covered
    flush()
    return blocks


def _bucket(value: int, steps: tuple[int, ...]) -> int:
    return sum(value >= step for step in steps)


def text_features(block: Block) -> tuple[str, ...]:
    """What the text itself tells."""
    text = block.text
    found = [
        f"size {_bucket(len(text), (20, 60, 120, 250))}",
        f"links {_bucket(int(100 * block.link_share), (1, 40, 80))}",
        f"commas {_bucket(text.count(','), (1, 3))}",
        "ends sentence" if text[-1] in ".!?…。:\"”" else "ends open",
    ]
    if "©" in text:
        found.append("copyright")
    if any(mark in text for mark in ("|", "»", "·")):
        found.append("separators")
    return tuple(found)


@dataclass
class ChainField:
    """Two labels, 1 being main text: weights of features, of neighbouring labels, and of a page's first block."""

    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray
    first: np.ndarray
    contexts: dict[tuple[str, ...], tuple[float, float]] = field(default_factory=dict)

    def _sum(self, names: tuple[str, ...]) -> tuple[float, float]:
        """Contexts and text features recur: their sums are kept."""
        known = self.contexts.get(names)
        if known is None:
            rows = [self.index[name] for name in names if name in self.index]
            total = self.weights[rows].sum(0) if rows else np.zeros(2)
            known = (float(total[0]), float(total[1]))
            if len(self.contexts) < 100_000:
                self.contexts[names] = known
        return known

    def main_blocks(self, blocks: list[Block]) -> list[bool]:
        """The most probable labelling (Viterbi)."""
        (p00, p01), (p10, p11) = self.pair.tolist()
        best0, best1 = self.first.tolist()
        back = []
        for at, block in enumerate(blocks):
            a0, a1 = self._sum(block.context)
            b0, b1 = self._sum(text_features(block))
            if at:
                from0, from1 = best0 + p00 < best1 + p10, best0 + p01 < best1 + p11
                best0, best1 = max(best0 + p00, best1 + p10), max(best0 + p01, best1 + p11)
                back.append((from0, from1))
            best0 += a0 + b0
            best1 += a1 + b1
        label = int(best1 > best0)
        labels = [label == 1]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label == 1)
        return labels[::-1][: len(blocks)]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 300, prior: float = 0.05) -> ChainField:
    """Maximise the likelihood of labelled pages (one label per leaf block); expectations by forward-backward."""
    read = [(leaf_blocks(page), labels) for page, labels in pages]
    for (blocks, labels), (page, _) in zip(read, pages):
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks: {page[:80]}")
    read = [(blocks, labels) for blocks, labels in read if blocks]
    names = [[block.context + text_features(block) for block in blocks] for blocks, _ in read]
    index = {name: i for i, name in enumerate(sorted({n for page in names for block in page for n in block}))}
    longest = max(len(page) for page in names)
    present = np.zeros((len(read), longest, len(index)), np.float32)
    mask = np.zeros((len(read), longest), bool)
    gold = np.zeros((len(read), longest), np.int64)
    for p, (page, (_, labels)) in enumerate(zip(names, read)):
        mask[p, : len(page)] = True
        gold[p, : len(page)] = labels
        for b, block in enumerate(page):
            present[p, b, [index[name] for name in block]] = 1
    flat = present.reshape(-1, len(index))
    truth = np.eye(2)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    true_pairs = np.einsum("pbi,pbj->ij", truth[:, :-1] * both[:, :, None], truth[:, 1:] * both[:, :, None])
    weights = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    speeds = [np.zeros_like(w) for w in weights]
    for _ in range(rounds):
        unary, pair, first = weights
        score = (flat @ unary.astype(np.float32)).astype(float).reshape(len(read), longest, 2)
        score[:, 0] += first
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for b in range(1, longest):
            step = np.logaddexp.reduce(forward[:, b - 1, :, None] + pair, axis=1) + score[:, b]
            forward[:, b] = np.where(mask[:, b, None], step, forward[:, b - 1])
        for b in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pair + (score[:, b + 1] + backward[:, b + 1])[:, None, :], axis=2)
            backward[:, b] = np.where(mask[:, b + 1, None], step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        expected = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(
            forward[:, :-1, :, None] + pair + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        error = truth - expected
        steps = [
            (flat.T @ error.reshape(-1, 2).astype(np.float32)).astype(float),
            true_pairs - joint.sum((0, 1)),
            error[:, 0].sum(0),
        ]
        for w, speed, step in zip(weights, speeds, steps):
            step = step - prior * w
            speed += step * step
            w += 0.5 * step / (np.sqrt(speed) + 1e-6)
    return ChainField(index, *weights)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Made-up pages of many layouts with a label per leaf block; the words are random, so only form is learned."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> list[str]:
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]

    def sentence(low: int = 4, high: int = 18) -> str:
        text = " ".join(words(low, high)).capitalize()
        return (text.replace(" ", ", ", 1) if rng.random() < 0.4 else text) + rng.choice((".", ".", ".", "?", "!"))

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def link(text: str) -> str:
        return f'<a href="/{text[:8]}">{text}</a>'

    def named(tag: str, *names: str) -> str:
        if not names:
            return tag
        name = rng.choice(names)
        name = rng.choice((name, name, f"site-{name}", f"{name}-box", f"{name} wide", f"page_{name}"))
        return f'{tag} {rng.choice(("class", "class", "id"))}="{name}"'

    def wrapped(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def menu_items() -> tuple[str, list[bool]]:
        n = rng.randint(2, 8)
        tag = rng.choice(("li", "li", "li", "div"))
        items = "".join(wrapped(tag, rng.choice((link, link, str))(" ".join(words(1, 3)))) for _ in range(n))
        return (wrapped("ul", items) if tag == "li" else items), [False] * n

    def paragraphs(n: int, tag: str, low: int = 1, high: int = 5) -> tuple[str, int]:
        texts = [prose(low, high) if rng.random() < 0.85 else sentence(1, 6).rstrip(".?!") for _ in range(n)]
        texts = [t.replace(" ", f" {link(words(1, 1)[0])} ", 1) if rng.random() < 0.15 else t for t in texts]
        ends = [f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "" for _ in texts]
        return "".join(f"<{tag}>{text}{end}" for text, end in zip(texts, ends)), n

    def nav() -> tuple[str, list[bool]]:
        inner, labels = menu_items()
        return wrapped(rng.choice(("nav", "nav", named("nav", "menu", "main", "primary"), named("div", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination"), 'div role="navigation"')), inner), labels

    def simple(tags: tuple[str, ...], prose_share: float = 0.6) -> tuple[str, list[bool]]:
        n = rng.randint(1, 3)
        plain = rng.random() < 0.5 and n == 1
        text = lambda: prose(1, 3) if rng.random() < prose_share else " ".join(words(1, 6))
        inner = text() if plain else "".join(wrapped(rng.choice(("p", "p", "div", "h3", "span")) if n == 1 else rng.choice(("p", "p", "div", "h3")), text()) for _ in range(n))
        return wrapped(rng.choice(tags), inner), [False] * n

    def advert() -> tuple[str, list[bool]]:
        return simple(("div class=\"ad\"", named("div", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner"), named("section", "promo", "ad"), named("aside", "ad", "promo")), 0.8)

    def sidebar() -> tuple[str, list[bool]]:
        if rng.random() < 0.5:
            inner, labels = menu_items()
            return wrapped(rng.choice(("aside", named("div", "sidebar", "related", "widget", "rail"))), wrapped("h3", "More") + inner), [False] + labels
        return simple(("aside", "aside", named("aside", "sidebar"), named("div", "sidebar", "widget", "related", "recommended", "trending"), 'div role="complementary"'))

    def notice() -> tuple[str, list[bool]]:
        return simple((named("div", "cookie", "cookies", "consent", "notice", "alert", "gdpr", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall"), named("section", "notice", "cookie"), 'div role="alert"', 'div role="dialog"', "dialog"), 0.9)

    def form() -> tuple[str, list[bool]]:
        n = rng.randint(1, 3)
        inner = "".join(wrapped(rng.choice(("p", "label", "div")) if n == 1 else rng.choice(("p", "div")), prose(1, 1) if rng.random() < 0.6 else " ".join(words(1, 4))) + '<input type="text">' for _ in range(n))
        return wrapped(rng.choice(("form", "form", 'form action="/go"', named("form", "search", "login", "signup", "contact"))), inner + "<button>Go</button>"), [False] * n

    def comments() -> tuple[str, list[bool]]:
        n = rng.randint(1, 4)
        inner, labels = "", []
        if rng.random() < 0.7:
            inner, labels = wrapped(rng.choice(("h2", "h3")), " ".join(words(1, 3))), [False]
        tag = rng.choice((named("div", "comment"), 'article class="comment"', "li", named("li", "comment"), "p", "div", "blockquote"))
        for _ in range(n):
            if rng.random() < 0.4 and not tag.startswith("p"):
                inner += wrapped(tag, wrapped("p", " ".join(words(1, 2))) + wrapped("p", prose(1, 3)))
                labels += [False, False]
            else:
                inner += wrapped(tag, prose(1, 3))
                labels.append(False)
        return wrapped(named(rng.choice(("section", "div", "div", "ol")), "comments", "comment", "replies", "responses", "discussion", "disqus", "reader-comments"), inner), labels

    def header() -> tuple[str, list[bool]]:
        inner, labels = rng.choice((menu_items, lambda: (wrapped(rng.choice(("h1", "p", "div")), " ".join(words(1, 4))), [False]), lambda: (wrapped("p", prose(1, 1)), [False])))()
        return wrapped(rng.choice(("header", "header", named("header", "top", "masthead"), named("div", "header", "masthead", "topbar", "top"), 'div role="banner"')), inner), labels

    def footer() -> tuple[str, list[bool]]:
        if rng.random() < 0.3:
            inner, labels = menu_items()
        else:
            text = rng.choice(("&copy; ", "&copy; ", "", "")) + rng.choice((prose(1, 2), " ".join(words(1, 6)), f"{words(1, 1)[0]}.example &middot; {prose(1, 2)}"))
            inner, labels = rng.choice((text, wrapped("p", text))), [False]
        return wrapped(rng.choice(("footer", "footer", named("footer", "site"), named("div", "footer", "copyright", "legal", "bottom"), 'div role="contentinfo"')), inner), labels

    def article() -> tuple[str, list[bool]]:
        inner, labels = "", []
        if rng.random() < 0.85:
            title = " ".join(words(2, 10)).capitalize() + rng.choice(("", "", ".", "?"))
            inner, labels = wrapped("h1" if rng.random() < 0.8 else "h2", title), [True]
        body = rng.choice(("p", "p", "p", "p", "p", "div"))
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.68:
                text, n = paragraphs(rng.randint(1, 3), body)
                inner, labels = inner + text, labels + [True] * n
            elif kind < 0.74:
                inner, labels = inner + wrapped(rng.choice(("h2", "h3", "h4")), " ".join(words(1, 7)).capitalize()), labels + [True]
            elif kind < 0.80:
                n = rng.randint(2, 5)
                inner += wrapped(rng.choice(("ul", "ol")), "".join(wrapped("li", rng.choice((sentence(), " ".join(words(1, 5))))) for _ in range(n)))
                labels = labels + [True] * n
            elif kind < 0.84:
                inner, labels = inner + wrapped(rng.choice(("blockquote", "pre")), prose(1, 2)), labels + [True]
            elif kind < 0.87:
                n = rng.randint(2, 4)
                inner += wrapped("table", "".join(wrapped("tr", wrapped("td", " ".join(words(1, 3)))) for _ in range(n)))
                labels = labels + [True] * n
            else:  # what interrupts an article
                text, more = rng.choice((advert, advert, sidebar, notice, form, nav))()
                inner, labels = inner + text, labels + more
        if rng.random() < 0.15:
            text, more = comments()
            inner, labels = inner + text, labels + more
        frame = rng.choice(
            ("article", "article", "article", "article", "main", named("article", "post", "entry", "story"), named("div", "content", "article", "post", "entry", "story", "main", "body", "text"), 'div role="main"', named("section", "content", "article", "story"))
        )
        if rng.random() < 0.15:
            inner = wrapped(named("div", "content", "body", "text", "inner", "wrapper"), inner)
        return wrapped(frame, inner), labels

    def plain() -> tuple[str, list[bool]]:
        """A page without any named frame: long paragraphs between short ones and links."""
        text, n = paragraphs(rng.randint(2, 6), "p", 3, 7)
        return wrapped("div", wrapped("h1", " ".join(words(3, 8))) + text), [True] * (n + 1)

    pages = []
    for _ in range(count):
        before = [part for part, share in ((notice, 0.25), (header, 0.5), (nav, 0.7), (advert, 0.5), (sidebar, 0.2), (form, 0.1)) if rng.random() < share]
        after = [part for part, share in ((comments, 0.35), (advert, 0.25), (sidebar, 0.4), (form, 0.2), (nav, 0.15), (footer, 0.9), (notice, 0.15)) if rng.random() < share]
        rng.shuffle(before)
        rows = [part() for part in (*before, plain if rng.random() < 0.1 else article, *after)]
        body = "".join(text + rng.choice(("", "\n")) for text, _ in rows)
        if rng.random() < 0.15:
            body = f'<div class="{rng.choice(("page", "container", "wrapper"))}">{body}</div>'
        title = " ".join(words(1, 5))
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>", [x for _, more in rows for x in more]))
    return pages


@lru_cache(maxsize=1)
def default_model() -> ChainField:
    """The field learned from ``labelled_pages``; the same in every process."""
    return train(labelled_pages())


def main_text(page: str, model: ChainField) -> str:
    """The main text of one page: its main blocks, one per line."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n".join(block.text for block, main in zip(blocks, model.main_blocks(blocks)) if main)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: ChainField | None = None
) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    text holds the main blocks in page order, joined by line breaks; within a block,
    character references are decoded and white space is one space. Pages
    without main text (NULL or empty html among them) have an empty text.
    n_chars counts its code points. Repeated rows get equal results; NULL ids and urls are
    kept; other columns are not read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), text_of(html_col).alias("html")
    )
    return source.mapInArrow(work, "page_id long, url string, text string, n_chars long")
