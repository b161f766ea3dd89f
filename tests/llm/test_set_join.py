"""The set join against all pairs, its skipped blocks, and the decisions around hubs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmill.llm import common, set_join, set_units

SCHEMA = "doc_id long, text string, node long, Element string, hub int"


def set_of(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return frozenset(windows or ([tuple(words)] if words else []))


def components_by_hand(rows, percent=85):
    sets = [set_of(text) for _, text in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((str(doc), len(sets[i]), str(least.get(root(i)) if doc is not None else None)) for i, (doc, _) in enumerate(rows))


def joined(spark, rows, percent=85):
    docs = spark.createDataFrame([(doc, text, 1, "own", 1) for doc, text in rows], SCHEMA).repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.linked_documents(docs, percent=percent).collect())


def edited(rng, words, edits):
    own = list(words)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return own


def texts(seed):
    """Groups of edited copies around the threshold, with and without their original, chains, boilerplate, odd rows."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    line = [word() for _ in range(12)]
    out = [None, "", " \n", "one", "One", "two words", "a b c d", "A B  C\nd", "a b c e"]
    for size, count in ((150, 30), (60, 25), (400, 12), (12, 20)):
        base = [word() for _ in range(size)]
        for _ in range(count):
            own = edited(rng, base, rng.choice((1, 2, 2, 3, 3, 4, 6)))
            out.append(" ".join(own + rng.choice(([], line))))
            if rng.random() < 0.2:
                base = own
    out += [" ".join([word() for _ in range(rng.randrange(20, 200))] + line) for _ in range(40)]
    out += out[20:24] * 3
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 80), (3, 70)])
def test_join_matches_all_pairs(spark, monkeypatch, seed, percent):
    if seed > 1:  # hot keys by broadcast, units cut into many blocks
        monkeypatch.setattr(common, "LIGHT_ROWS", 3)
        for name in ("HUB_MEMBERS", "OWN_STRAYS", "OTHER_MEMBERS"):
            monkeypatch.setattr(set_units, name, 5)
    rows = list(enumerate(texts(seed)))
    rows += [(3, rows[3][1]), (3, rows[60][1]), (None, rows[60][1]), (None, None)]
    assert joined(spark, rows, percent) == components_by_hand(rows, percent)


def test_no_rows_and_no_words(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, ""), (1, None)]) == [("1", 0, "1"), ("1", 0, "1"), ("2", 0, "2")]


@pytest.mark.parametrize("percent", [70, 85])
def test_skipped_blocks_hold_no_link(percent):
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = np.sort(rng.integers(1, rng.choice((8, 40)), rng.integers(1, 12)))
        pos = np.array([rng.integers(0, s) for s in size])
        order = np.lexsort((pos, size))
        size, pos = size[order], pos[order]
        keep = np.ones(len(size), bool)
        keep[1:] = (size[1:] != size[:-1]) | (pos[1:] != pos[:-1])
        size, pos = size[keep], pos[keep]
        n = rng.integers(1, 3, len(size))
        live = set_join.live_blocks(size, pos, n, percent)
        for i in range(len(size)):
            reach = [
                min(size[i] - pos[i], size[j] - pos[j]) * (100 + percent) >= percent * (size[i] + size[j]) and (i != j or n[i] > 1)
                and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])
                for j in range(len(size))
            ]
            assert live[i] or not any(reach)


def test_work_on_a_group_of_unlinked_near_copies_grows_in_proportion(spark):
    """Texts that differ pairwise in some words, none linked: rows handed to the units, per text."""
    made = {}
    for count in (60, 240):
        rng = random.Random(9)
        base = [f"b{i}" for i in range(300)]
        rows = [(i, " ".join(edited(rng, base, 12))) for i in range(count)]
        docs = spark.createDataFrame([(doc, text, 1, "own", 1) for doc, text in rows], SCHEMA)
        source = set_join._documents(docs, "doc_id", "text")
        sets = set_join.described(source, 85).select("node", F.col("n_shingles").alias("size"), F.col("head").alias("set"))
        entries = set_join.index_entries(set_join.set_records(sets), 85)
        made[count] = sum(r.n for r in set_join.index_lists(entries, 85).collect())
        assert joined(spark, rows) == components_by_hand(rows)
    assert made[240] <= 8 * made[60] + 240
