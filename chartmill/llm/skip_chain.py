"""Personal data: base patterns, and a skip-chain conditional random field beside them.

The field labels tokens (runs without white space) as e-mail address, IP
address, card number, phone number or nothing. Its potentials: features of a
token and its neighbours; the labels of adjacent tokens; and, across any distance in the
document, agreement of tokens that are the same or similar (the same digits in
another notation; the local part of an address). Loopy sum-product message
passing over chain and skip links gives each token its marginal, so a certain
occurrence of a number vouches for a doubtful one elsewhere in the document.

Only tokens with a digit, ``@`` or ``+``, and tokens that repeat (part of) such a one,
can be personal data of these kinds; all others have the label "nothing" with
certainty, and so end the chain on either side. Equal tokens are linked
in a row, each to the next one, so n occurrences have n - 1 links.

The weights are learned by maximising the pseudo-likelihood on labelled
documents made by ``labelled_documents`` (or given ones).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: Marginal probability from which the field's labels count.
CERTAINTY = 0.97
#: Labelled documents the weights are learned from.
TRAINING_DOCUMENTS = 600
MAX_ROUNDS = 60

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# from the first digit of a run on only: a later one could give no other match, and each would scan the run again
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MARKED = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"\S+")
_EDGES = "()[]{}<>,;:!?\"'"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0")[:3] or 0) <= 255 for part in found.split("."))
    if kind == "email":
        return True
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, kind by kind, leftmost and without overlaps within a kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", m.start(), m.end()) for m in _email_matches(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return spans


def _email_matches(text: str) -> Iterator[re.Match]:
    """All leftmost matches; each is searched from the beginning of the run of characters before its ``@`` only."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        match = _EMAIL.match(text, begin) if begin < at else None
        if match:
            yield match
            done = match.end()
        at = text.find("@", max(at + 1, done))


# --- the field ------------------------------------------------------------


def _shape(token: str) -> str:
    """A token's form: runs of letters as a, of digits as 9 with their number (up to 5), other characters as they are."""
    return re.sub(
        "[0-9]+", lambda m: f"9{min(len(m.group()), 5)}", re.sub(r"[^\W\d_]+", "a", token[:80])
    )[:24]


def _features(token: str) -> list[str]:
    core = token.strip(_EDGES).rstrip(".")
    digits = _NOT_DIGIT.sub("", core)
    letters = any(c.isalpha() for c in core)
    found = [f"shape={_shape(core)}", f"digits={len(digits) if len(digits) < 5 else 5 + len(digits) // 4}", f"letters={letters}"]
    if _EMAIL.fullmatch(core):
        found.append("email")
    elif "@" in core:
        found.append("at")
    if _IP.fullmatch(core):
        found.append("quad" if _valid("ip", core) else "wide quad")
    if not letters and 16 <= len(digits) <= 19:
        found.append("luhn" if luhn(digits) else "no luhn")
    if core.startswith("+"):
        found.append("plus")
    if token.startswith("("):
        found.append("bracket")
    if any(c in core for c in "=/\\_#$&*%"):
        found.append("code")
    return found


@dataclass
class Document:
    """The tokens of a text that can be personal data, with their links."""

    spans: list[tuple[int, int]]
    features: list[list[str]]
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int, int]]  # from, to, 0: same token, 1: similar


def _names_in(core: str) -> list[str]:
    """What a token may be mentioned by elsewhere: itself, and the local part of an address."""
    local = core.partition("@")[0] if _EMAIL.fullmatch(core) else ""
    return [core.lower()] + ([local.lower()] if len(local) >= 5 else [])


def read_document(text: str) -> Document | None:
    """None if no token has a digit, ``@`` or ``+``."""
    if not _MARKED.search(text):
        return None
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    cores = [token.strip(_EDGES).rstrip(".") for _, _, token in tokens]
    marked = [bool(_MARKED.search(core)) for core in cores]
    names = {name for core, own in zip(cores, marked) if own for name in _names_in(core)}
    chosen = [i for i, core in enumerate(cores) if marked[i] or core.lower() in names]
    place = {i: at for at, i in enumerate(chosen)}
    features = []
    for i in chosen:
        own = _features(tokens[i][2])
        for side, j in (("before", i - 1), ("after", i + 1)):
            beside = _shape(cores[j]) if j in place else "word" if 0 <= j < len(tokens) else "edge"
            own += [f"{side}={beside}", f"{own[0]} {side}={beside}"]
        features.append(own)
    chain = [(place[i], place[i + 1]) for i in chosen if i + 1 in place]
    skips, last_same, last_like = [], {}, {}
    for at, i in enumerate(chosen):
        core = cores[i].lower()
        digits = _NOT_DIGIT.sub("", core)
        if len(core) >= 5:
            if core in last_same and last_same[core] < at - 1:
                skips.append((last_same[core], at, 0))
            last_same[core] = at
        for like in ([digits] if len(digits) >= 7 else []) + _names_in(cores[i])[1:] + ([core] if not marked[i] else []):
            if like in last_like and last_like[like] != last_same.get(core) and last_like[like] < at - 1:
                skips.append((last_like[like], at, 1))
            last_like[like] = at
    spans = []
    for i in chosen:
        begin, end, token = tokens[i]
        lead = len(token) - len(token.lstrip(_EDGES.replace("(", "")))
        tail = len(token) - len(token.rstrip(_EDGES.replace(")", "") + "."))
        spans.append((begin + lead, max(begin + lead, end - tail)))
    return Document(spans, features, chain, skips)


@dataclass
class SkipChain:
    """Weights: features by label, label pairs of neighbours, agreement over the two kinds of skip links."""

    index: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray
    skip: np.ndarray

    def scores(self, doc: Document) -> np.ndarray:
        rows = [[self.index[f] for f in own if f in self.index] for own in doc.features]
        return np.stack([self.unary[row].sum(0) for row in rows])

    def marginals(self, doc: Document) -> np.ndarray:
        """Sum-product over all links at once until the messages rest; exact where the links form no loop."""
        local = self.scores(doc)
        links = [(a, b, self.pair) for a, b in doc.chain]
        links += [(a, b, self.skip[kind] * np.eye(len(KINDS) + 1)) for a, b, kind in doc.skips]
        if not links:
            return _normal(local)
        source = np.array([a for a, _, _ in links] + [b for _, b, _ in links])
        target = np.array([b for _, b, _ in links] + [a for a, _, _ in links])
        table = np.stack([p for _, _, p in links] + [p.T for _, _, p in links])
        count = len(links)
        reverse = np.concatenate([np.arange(count, 2 * count), np.arange(count)])
        messages = np.zeros((2 * count, local.shape[1]))
        for _ in range(MAX_ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            out = _log_sum((belief[source] - messages[reverse])[:, :, None] + table, 1)
            out -= out.max(1, keepdims=True)
            moved = np.abs(out - messages).max()
            messages = 0.5 * messages + 0.5 * out if doc.skips else out
            if moved < 1e-4:
                break
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _normal(belief)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def gold_labels(doc: Document, spans: list[Span]) -> np.ndarray:
    """The label of each token by the labelled spans it overlaps: 0 nothing, else 1 + the kind's place."""
    labels = np.zeros(len(doc.spans), np.int64)
    for kind, begin, end in spans:
        for at, (start, stop) in enumerate(doc.spans):
            if start < end and begin < stop:
                labels[at] = 1 + KINDS.index(kind)
    return labels


def train(labelled: list[tuple[str, list[Span]]], rounds: int = 500, prior: float = 0.02) -> SkipChain:
    """Maximise the pseudo-likelihood: each token's label given its features and the labels linked to it."""
    docs = [(doc, gold_labels(doc, spans)) for text, spans in labelled if (doc := read_document(text))]
    index = {name: i for i, name in enumerate(sorted({f for doc, _ in docs for own in doc.features for f in own}))}
    size = len(KINDS) + 1
    gold, rows, columns, links = [], [], [], []  # links: token, label of its neighbour, 0 before, 1 after, 2 same, 3 similar
    base = 0
    for doc, labels in docs:
        gold += labels.tolist()
        for at, own in enumerate(doc.features):
            rows += [base + at] * len(own)
            columns += [index[f] for f in own]
        for a, b in doc.chain:
            links += [(base + b, labels[a], 0), (base + a, labels[b], 1)]
        for a, b, kind in doc.skips:
            links += [(base + b, labels[a], 2 + kind), (base + a, labels[b], 2 + kind)]
        base += len(labels)
    gold = np.array(gold)
    present = np.zeros((len(gold), len(index)), np.float32)
    present[rows, columns] = 1
    links = np.array(links, np.int64).reshape(-1, 3)
    weights = [np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(2)]
    speeds = [np.zeros_like(w) for w in weights]
    truth = np.eye(size)[gold]
    for _ in range(rounds):
        unary, pair, skip = weights
        score = (present @ unary.astype(np.float32)).astype(float)
        for way, part in ((0, pair), (1, pair.T)):
            own = links[links[:, 2] == way]
            np.add.at(score, own[:, 0], part[own[:, 1]])
        for kind in (0, 1):
            own = links[links[:, 2] == 2 + kind]
            np.add.at(score, (own[:, 0], own[:, 1]), skip[kind])
        error = truth - _normal(score)
        steps = [np.zeros_like(w) for w in weights]
        steps[0] += present.T @ error.astype(np.float32)
        for way in (0, 1):
            own = links[links[:, 2] == way]
            part = np.zeros((size, size))
            np.add.at(part, own[:, 1], error[own[:, 0]])
            steps[1] += part if way == 0 else part.T
        for kind in (0, 1):
            own = links[links[:, 2] == 2 + kind]
            steps[2][kind] = error[own[:, 0], own[:, 1]].sum()
        for w, speed, step in zip(weights, speeds, steps):
            step = step - prior * w  # a normal prior on the weights
            speed += step * step
            w += 0.5 * step / (np.sqrt(speed) + 1e-6)
    return SkipChain(index, *weights)


def labelled_documents(count: int = TRAINING_DOCUMENTS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up documents with personal data in several notations, mentions repeated, and look-alikes that are none."""
    rng = random.Random(seed)

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 10)))

    def card_number(valid: bool) -> str:
        while True:
            number = rng.choice("3456") + digits(rng.choice((15, 15, 15, 18)))
            if luhn(number) == valid:
                return number

    def email() -> str:
        local = rng.choice((f"{word()}.{digits(2)}", f"{word()}.{word()}", word() + digits(3), f"{word()}_{word()}"))
        return f"{local}@{word()}{rng.choice(('', digits(1)))}.{rng.choice(('example.com', 'org', 'co.uk', 'de'))}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        number = card_number(True)
        return rng.choice((number, number, " ".join(re.findall("....?", number)), "-".join(re.findall("....?", number))))

    def phone() -> str:
        a, b, c, land = digits(3), digits(3), digits(4), rng.choice(("1", "44", "49", "33"))
        return rng.choice((f"+{land} ({a}) {b}-{c}", f"+{land} {a} {b} {c}", f"+{land}-{a}-{b}-{c}", f"+{land}{a}{b}{c}"))

    def harmless() -> str:
        return rng.choice(
            (
                f"{rng.randint(1900, 2030)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}",
                f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", digits(rng.randint(1, 12)), f"{rng.randint(1, 9)}.",
                f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{digits(3)}-{digits(4)}", f"({digits(rng.randint(1, 4))})",
                f"{rng.randint(0, 23)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%", f"{word()}{digits(2)}", f"AKIA{digits(4)}{word().upper()}{digits(2)}",
                f"password={hashlib.md5(digits(5).encode()).hexdigest()[:18]}", f'"{hashlib.sha1(digits(5).encode()).hexdigest()}"',
                card_number(False), ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"@{word()}", f"{word()}@{word()}", "+", f"+{digits(1)}", f"{word()}+{word()}",
                f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}.{digits(2)}", f"{digits(20)}", f"{digits(4)} {digits(4)}", f"{digits(13)}", digits(14), digits(16 + 8),
                f"/{word()}/{digits(5)}", f"#{digits(4)}", f"{digits(1)}x{digits(2)}",
            )
        )

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    documents = []
    for _ in range(count):
        parts: list[tuple[str, str]] = []
        for _ in range(rng.randint(2, 9)):
            parts += [("", word()) for _ in range(rng.randint(1, 6))]
            if rng.random() < 0.5:
                parts.append(("", harmless()))
                continue
            kind = rng.choice(KINDS)
            value = makers[kind]()
            parts.append((kind, value))
            if rng.random() < 0.4:  # mentioned again, some distance away
                parts += [("", word()) for _ in range(rng.randint(2, 12))]
                parts.append((kind, value))
        text, spans = "", []
        for kind, value in parts:
            value = value if kind or rng.random() < 0.9 else value + rng.choice(",.")
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + rng.choice((" ", " ", " ", ", " if kind else " ", ".\n"))
        documents.append((text, spans))
    return documents


@lru_cache(maxsize=1)
def default_model() -> SkipChain:
    """The field learned from ``labelled_documents``; the same in every process."""
    return train(labelled_documents())


def field_spans(text: str, model: SkipChain, certainty: float = CERTAINTY) -> list[Span]:
    """Spans of the tokens the field is certain of; a number over several tokens is one span."""
    doc = read_document(text)
    if doc is None:
        return []
    marginals = model.marginals(doc)
    labels = np.where(marginals[:, 1:].max(1) >= certainty, marginals.argmax(1), 0)
    chained = set(doc.chain)
    spans: list[Span] = []
    for at, label in enumerate(labels.tolist()):
        begin, end = doc.spans[at]
        if not label or begin == end:
            continue
        kind = KINDS[label - 1]
        goes_on = (
            kind in ("card", "phone") and at and labels[at - 1] == label and (at - 1, at) in chained and text[begin] != "+"
        )
        if goes_on and spans and spans[-1][2] <= begin:
            spans[-1] = (kind, spans[-1][1], end)
        else:
            spans.append((kind, begin, end))
    return spans


def all_spans(text: str, model: SkipChain, certainty: float = CERTAINTY) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of the field that overlap none of them."""
    base = base_spans(text)
    taken = sorted((begin, end) for _, begin, end in base)
    begins = np.array([begin for begin, _ in taken])
    reach = np.maximum.accumulate(np.array([end for _, end in taken])) if taken else np.zeros(0)
    added = []
    for kind, begin, end in field_spans(text, model, certainty):
        at = int(np.searchsorted(begins, end)) if taken else 0
        if at == 0 or reach[at - 1] <= begin:
            added.append((kind, begin, end))
    return base, sorted(base + added, key=lambda span: (KINDS.index(span[0]), span[1]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SkipChain | None = None, certainty: float = CERTAINTY
) -> DataFrame:
    """(doc_id, base_spans, spans) for every document; spans are arrays of (kind, start, end) in code points.

    Ends are exclusive; spans are ordered by kind (email, ip, card, phone), then start.
    NULL text counts as empty and has no spans; repeated rows get equal results; a NULL
    id is kept; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                own, every = all_spans(text, shared.value, certainty) if _MARKED.search(text) else ([], [])
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base_spans", "spans"]
            )

    source = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(work, f"doc_id long, base_spans {_SPANS}, spans {_SPANS}")


def _listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_listed("base_spans"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", model: SkipChain | None = None, certainty: float = CERTAINTY) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there is one, follows the text.

    Overlapping spans of different kinds are replaced together, named after the
    first. A NULL text stays NULL. All rows and columns are kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda text: _redacted(text, shared.value, certainty), na_action="ignore")

    out = docs.withColumn(text_col, cleaned(col(text_col)))
    sizes = [name for name in docs.columns if name.lower() == "n_chars"]
    for name in sizes:
        out = out.withColumn(name, F.length(col(text_col)).cast(docs.schema[name].dataType))
    return out.select(*[col(name) for name in docs.columns])


def _redacted(text: str, model: SkipChain, certainty: float) -> str:
    if not _MARKED.search(text):
        return text
    parts, done = [], 0
    for kind, begin, end in sorted(all_spans(text, model, certainty)[1], key=lambda span: (span[1], -span[2])):
        if begin >= done:
            parts += [text[done:begin], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]
