"""The divergence of sources against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from chartmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest string, `split` int, Low string"


def audited_by_hand(rows, least, top=50):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)) for text, _, _ in rows]
    groups = [(lang or "", source or "") for _, lang, source in rows]
    out = []
    for lang in {g[0] for g in groups}:
        seen = Counter(t for own, g in zip(terms, groups) if g[0] == lang for t in set(own))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = {g: Counter(t for own, h in zip(terms, groups) if h == g for t in own if seen[t] >= least) for g in groups if g[0] == lang}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for (_, source), own in count.items():
            pairs = [(s, sum(abs(share(own, t) - share(c, t)) for t in kept)) for (_, s), c in count.items() if s != source]
            found = [(t, share(own, t) - share(whole, t)) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", found)):
                ranked = sorted(items, key=lambda item: (-item[1], item[0].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def table(seed=4, count=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéßЖ日x") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["AbC", "İx", "don't", "a1b", "K"]
    rows = [(None, None, None), ("", "", ""), ("12 ' 34", "en", "empty"), ("\x00\x7f@[`{", "en", "empty")]
    while len(rows) < count:
        text = rng.choice((" ", "-", "\n")).join(rng.choice(words[: rng.choice((10, 65))]) for _ in range(rng.randint(0, 30)))
        rows += [(text, rng.choice(("en", "en", "de", None)), rng.choice(("s0", "s0", "s1", "s2", None)))] * rng.choice((1, 1, 2))
    return rows


def audited(spark, rows, least, **kwargs):
    docs = spark.createDataFrame([(i, *row, "own", 1, "own") for i, row in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, divergence.audit_sources(docs, min_documents=least, **kwargs).collect()))


@pytest.mark.parametrize("bits", [64, 5])
def test_audit_matches_a_plain_count(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "DIGEST_BITS", bits)  # at 5 bits, most digests belong to several terms
    rows = table()
    assert audited(spark, rows, 4) == audited_by_hand(rows, 4)


def test_units_of_any_size_and_ties_at_the_last_rank(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_TERMS", 7)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    rows = table(seed=5) + [("tie%s b c" % "abcdefgh"[i % 8], "fr", "one") for i in range(16)] + [("other", "fr", "two")] * 3
    rows += [("tiea b c", "fr", f"s{i}") for i in range(5)]
    assert audited(spark, rows, 2, top=3) == audited_by_hand(rows, 2, 3)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, "de", None)]
    assert audited(spark, rows, 30) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_text_is_cut_where_terms_end(monkeypatch):
    text = "word another " * 2000 + "x" * 300 + " word"
    whole = divergence.batch_terms(pa.array([text, "b word"]))[1][:3]
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 64)
    monkeypatch.setattr("chartmill.llm.textscan.CHUNK_BYTES", 64)
    assert divergence.batch_terms(pa.array([text, "b word"]))[1][:3].tolist() == whole.tolist()
