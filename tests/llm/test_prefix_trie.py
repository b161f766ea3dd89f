"""The trie of rebuilt conversations against one built from whole turns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from chartmill.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, fp string, Depth int, digest string"


def trie_by_hand(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    turns = {conv: [own[1:] for own in sorted(listed)] for conv, listed in turns.items()}
    rebuilt = {}
    for conv, own in turns.items():
        head = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(conv - 20 * int(conv / 20))
        rebuilt[conv] = tuple(turns.get(base, [])[:head] + own[head:])
    members, ends = {}, {}
    for conv, path in rebuilt.items():
        for depth in range(len(path) + 1):
            members.setdefault(path[:depth], []).append(conv)
        ends.setdefault(path, []).append(conv)
    own = {node: (len(convs) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0 for node, convs in members.items()}
    out = []
    for node, convs in members.items():
        under = [other for other in members if other[: len(node)] == node]
        children = [other for other in under if len(other) == len(node) + 1]
        leaves = [leaf for leaf in under if not any(len(o) == len(leaf) + 1 and o[:-1] == leaf for o in members)]
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), sum(own[o] for o in under), digest))
    return sorted(out, key=str)


def conversations(seed, count=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        conv = rng.choice((rng.randrange(-45, 90), 20 * rng.randrange(4)))
        for turn in range(rng.choice((1, 2, 3, 5, 9))):
            rows.append((conv, rng.choice((turn, turn, turn, None, 7)), rng.choice(("user", "bot", None)), rng.choice((None, "", "a  b", "ab", " é\x85x \n y", "c"))))
    rows += [(None, 0, "user", "no id"), (1000, 0, "user", "alone"), (1003, 0, "user", "same"), (1003, 0, "user", "same")]
    rows += [(40, 100 + i, "user", "ab") for i in range(40)]
    return rows


def built(spark, rows, **kwargs):
    table = spark.createDataFrame([(*row, "own", 1, "own") for row in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie.conversation_trie(table, **kwargs).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_one_of_whole_turns(spark, seed):
    rows = conversations(seed)
    assert built(spark, rows) == trie_by_hand(rows)


def test_segments_blocks_clashes_and_hot_nodes(spark, monkeypatch):
    """Conversations that span tasks, paths in several blocks, end lists in several blocks, clashing fingerprints, broadcast parents."""
    monkeypatch.setattr(prefix_trie, "BLOCK_DEPTHS", 3)
    monkeypatch.setattr(prefix_trie, "END_BLOCK_BITS", 2)
    monkeypatch.setattr(common, "LIGHT_ROWS", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = conversations(3)
        assert built(spark, rows, modulus=5) == trie_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_combine_and_undo():
    maps = prefix_trie.Maps()
    a, b, c = (maps.of(bytes([i]) * 32) for i in range(3))
    whole = maps.product(maps.product(a, b), c)
    assert whole == maps.product(a, maps.product(b, c)) != maps.product(maps.product(b, a), c)
    assert maps.product(maps.inverse(maps.product(a, b)), whole) == c
    assert maps.unpacked(maps.packed(whole)) == whole
