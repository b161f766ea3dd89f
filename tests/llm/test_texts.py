"""Token files, packing, near-duplicates and quality rules against brute force on small tables."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartmill.llm import components, hamming_join, kn_quality, packing, separator_scan, set_units
from chartmill.llm.components import connected_components
from chartmill.llm.textscan import chunks, shingle_sets, word_hashes
from chartmill.llm.tokens import END_OF_DOCUMENT, default_vocabulary, token_ids

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "naïve café — 日本語 \U0001f600 don't I'LL",
    "a b c\x85d\x1ce f",
    "<|endoftext|> inside <|endoftext|>",
    "x" * 5000,
    "word " * 3000,
    "\x0b\x0cA B\x00C",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string, Label int"


def documents(spark, texts, ids=None):
    rows = [
        (i if ids is None else ids[i], text, ("en", "de", None)[i % 3], ("a", None)[i % 2], None, "clash", "clash", i)
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def varied_texts(seed=3, count=120):
    """Texts with exact copies, near copies of all degrees, chains of edits, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABCDE") for _ in range(rng.randint(1, 6)))
    texts = list(ODD_TEXTS)
    originals = [[word() for _ in range(rng.choice((3, 5, 30, 120, 400)))] for _ in range(12)]
    while len(texts) < count:
        own = list(rng.choice(originals))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 9))):
            own[rng.randrange(len(own))] = word()
        texts.append(rng.choice((" ", "  ", "\n")).join(own))
        if rng.random() < 0.3:
            originals.append(own)
    return texts


# --- tokens -----------------------------------------------------------------


@pytest.mark.parametrize("special", [False, True])
def test_ids_are_those_of_the_tokenizers_library(special):
    reference = Tokenizer.from_file(default_vocabulary())
    reference.encode_special_tokens = special
    for text in [t or "" for t in varied_texts(count=60)]:
        expected = reference.encode(text, add_special_tokens=False).ids
        assert token_ids(text, default_vocabulary(), specials_as_text=special).tolist() == expected


def test_separator_scan_counts_every_document(spark):
    docs = documents(spark, varied_texts(count=60)).repartition(3)
    got = {r.doc_id: r.n_tokens for r in separator_scan.document_token_counts(docs).collect()}
    want = {
        r.doc_id: len(token_ids(r.text or "", default_vocabulary(), specials_as_text=True)) for r in docs.collect()
    }
    assert got == want and got[0] == got[1] == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_are_stitched_at_any_size(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    sep = END_OF_DOCUMENT
    files = {
        "a": [5, 6, sep, sep, 7, sep],
        "b": [sep],
        "c": [1, 2, 3],
        "d": [1, sep, 2],
        "e": [],
        "f": np.where(rng.random(300) < 0.1, sep, 9).tolist(),
        "g": [9] * 40 + [sep],
    }
    expected = set()
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        at, ordinal = 0, 0
        for place, token in enumerate(ids):
            if token == sep:
                expected.add((f"{name}.bin", ordinal, place - at, True))
                at, ordinal = place + 1, ordinal + 1
        if at < len(ids):
            expected.add((f"{name}.bin", ordinal, len(ids) - at, False))
    got = separator_scan.count_tokens(spark, f"file://{tmp_path}", block_tokens=block)
    assert {tuple(r) for r in got.collect()} == expected


def test_the_prefix_scan_carries_no_lengths(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, END_OF_DOCUMENT] * 50, "<u2").tobytes())
    plan = separator_scan.count_tokens(spark, f"file://{tmp_path}", block_tokens=8)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    sorted_rows = below[: below.index("FileScan") + 400].split("ReadSchema")[0]
    assert "inner" not in sorted_rows


def test_ids_wider_than_the_files_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separator_scan, "MAX_ID", 100)
    docs = documents(spark, ["several words of ordinary text"])
    with pytest.raises(Exception, match="does not fit"):
        separator_scan.write_token_files(docs, f"file://{tmp_path}/out").count()


def test_empty_table_has_no_token_counts(spark):
    assert separator_scan.document_token_counts(documents(spark, []).filter("false")).count() == 0


# --- packing ----------------------------------------------------------------


def test_packing_places_every_id_once(spark):
    docs = documents(spark, varied_texts(count=100) + ["twice", "twice"], ids=[*range(100), 500, 500]).repartition(2)
    pieces = packing.pack(docs).toPandas()
    by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, own in by_sequence:
        assert (own.offset == own.length.cumsum() - own.length).all()
        assert own.length.sum() <= packing.LENGTH
    want = collections.defaultdict(list)
    for row in docs.collect():
        want[row.doc_id].append([*token_ids(row.text or "", default_vocabulary()).tolist(), packing.END_ID])
    for doc_id, own in pieces.sort_values(["doc_id", "sequence_id", "start"]).groupby("doc_id"):
        if doc_id == 500:
            assert len(own) == 2 and set(own.length) == {len(want[500][0])}
            continue
        own = own.sort_values("start")
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == want[doc_id][0] and set(own.doc_tokens) == {len(ids)}
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    assert set(pieces.doc_id) == set(want)


def test_piece_checksums(spark):
    docs = documents(spark, ["hello world"])
    ids = np.append(token_ids("hello world", default_vocabulary()), packing.END_ID).astype("<u4")
    rows = packing.piece_digests(packing.pack(docs)).collect()
    assert sum(row.length for row in rows) == len(ids)
    for row in rows:
        assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes()) and row.doc_tokens == len(ids)


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(4)
    packer = packing.LevelPacker(length=32, max_open=10_000)
    for doc in range(400):
        size = rng.randint(1, 31)
        counts = [0] + [int(n) // 2 for n in packer.twice[1:32]]

        def total(level, size=size, counts=counts):
            after = list(counts)
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return sum(n * n for n in after)

        choices = [0] + [level for level in range(1, 32 - size + 1) if counts[level]]
        assert total(packer.level_for(size)) == min(map(total, choices))
        packer.add(doc, np.zeros(size, np.uint32))


def test_leftover_windows_need_no_padding():
    rng = random.Random(9)
    for max_open in (2, 5, 1000):
        packer = packing.LevelPacker(length=64, max_open=max_open)
        sizes = [rng.randint(1, 150) for _ in range(200)]
        for doc, size in enumerate(sizes):
            packer.add(doc, np.arange(size, dtype=np.uint32))
            assert packer.open <= max_open
        packer.finish()
        fill = collections.Counter()
        placed = collections.defaultdict(list)
        for doc_id, start, size, _, sequence, _, ids in packer.rows:
            fill[sequence] += size
            placed[doc_id].append((start, np.frombuffer(ids, "<u4").tolist()))
        assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())
        for doc, size in enumerate(sizes):
            assert [x for _, ids in sorted(placed[doc]) for x in ids] == list(range(size))


def test_empty_table_packs_to_nothing(spark):
    assert packing.pack(documents(spark, []).filter("false")).count() == 0


# --- words, shingles, near-duplicates ----------------------------------------


def test_words_and_shingles_match_the_pattern():
    texts = [t or "" for t in varied_texts(count=80)]
    for lower in (False, True):
        seen = {}
        for first, data, offsets in chunks(pa.array(texts)):
            hashes, at = word_hashes(data, offsets, lower)
            for i in range(len(offsets) - 1):
                words = words_of(texts[first + i])
                assert at[i + 1] - at[i] == len(words)
                for word, value in zip(words, hashes[at[i] : at[i + 1]].tolist()):
                    word = word.translate({c: c + 32 for c in range(65, 91)}) if lower else word
                    assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def sets_of(texts):
    out = []
    for text in texts:
        words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def test_shingle_set_sizes():
    texts = [t or "" for t in varied_texts(count=80)]
    sizes = [len(s) for _, data, offsets in chunks(pa.array(texts)) for s in shingle_sets(data, offsets)]
    assert sizes == [len(s) for s in sets_of(texts)]


def classes_by_brute_force(texts, percent=85):
    sets = sets_of(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block_members", [1024, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block_members):
    for name in ("HUB_MEMBERS", "OWN_STRAYS", "OTHER_MEMBERS"):
        monkeypatch.setattr(set_units, name, block_members)
    texts = varied_texts(seed=8, count=260)
    got = {r.doc_id: r for r in hamming_join.near_duplicates(documents(spark, texts)).collect()}
    classes, sizes = classes_by_brute_force(texts)
    assert [got[i].component_id for i in range(len(texts))] == classes
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_rows(spark):
    texts = ["a b c d e f", "A  b\nc d e f", "a b c", "a b c", None, None, "", "a b c d e f"]
    docs = documents(spark, texts, ids=[7, 3, 9, 9, 1, 2, 4, None])
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hamming_join.near_duplicates(docs).collect()]
    want = [(7, 2, 3, False), (3, 2, 3, True), (9, 1, 9, True), (9, 1, 9, True), (1, 0, 1, True), (2, 0, 2, True), (4, 0, 4, True)]
    assert sorted(got, key=str) == sorted([*want, (None, 2, None, True)], key=str)
    assert hamming_join.near_duplicates(docs.filter("false")).count() == 0


def test_signatures_within_the_distance_always_share_a_key(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, hamming_join.SLOTS, dtype=np.uint8)
    sigs = [base]
    for _ in range(60):
        other = base.copy()
        at = rng.choice(hamming_join.SLOTS, hamming_join.DISTANCE, replace=False)
        other[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
        sigs.append(other)
    nodes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "node long, sig binary")
    keys = collections.defaultdict(set)
    for row in hamming_join.signature_keys(nodes).collect():
        keys[row.node].add(row.key)
    assert all(keys[0] & keys[i] for i in range(1, len(sigs)))


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- quality ----------------------------------------------------------------


def statistics_by_brute_force(text):
    words = words_of(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if windows[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_small_tables_are_in_few_files_however_many_shuffle_partitions(spark, monkeypatch):
    """An executor starts processes for every file it writes to a local file system; small tables do not spread over all partitions."""
    rng = random.Random(8)
    words = [[rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(60)]
    rows = [(2 * i, " ".join(own)) for i, own in enumerate(words)] + [(2 * i + 1, " ".join(own + ["end"])) for i, own in enumerate(words)]
    files = {}
    for module in (hamming_join, set_units, components):

        def counted(df, name, *args, keep=module.written, of=module.__name__.rpartition(".")[2], **more):
            table = keep(df, name, *args, **more)
            files[f"{of}.{name}"] = max(files.get(f"{of}.{name}", 0), len(table.inputFiles()))
            return table

        monkeypatch.setattr(module, "written", counted)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
        assert {row.doc_id: row.component_id for row in found.collect()} == {i: i - i % 2 for i in range(120)}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    bounded = {f"hamming_join.{name}" for name in ("nodes", "keys", "units", "hubs", "wanted", "labels", "placed", "sizes", "clusters", "classes")}
    bounded |= {"components.links", "set_units.hubs", "set_units.labelled", "set_units.mixed"}
    many = {name: n for name, n in files.items() if name in bounded and n > spark.sparkContext.defaultParallelism}
    assert bounded <= files.keys() and not many, many


def test_statistics_match_brute_force(spark):
    texts = varied_texts(seed=5, count=80) + ["a b c a b c x", "l 1\nl 1\n\n \nl 2\nl 1", "#a $b é|ü <>", "r r r r"]
    got = {r.doc_id: r for r in kn_quality.judge(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        row, want = got[i], statistics_by_brute_force(text)
        assert tuple(row[name] for name in kn_quality.STATISTICS) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)


def kneser_ney_by_brute_force(texts, order):
    """Interpolated modified Kneser-Ney over folded symbols, by dictionaries."""
    grams = collections.Counter()
    for text in texts:
        symbols = [0] * (order - 1) + kn_quality.FOLD[np.frombuffer(text.encode(), np.uint8)].tolist()
        grams.update(tuple(symbols[i : i + order]) for i in range(len(symbols) - order + 1))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(gram[1:] for gram in tables[n + 1])
    taken = {n: kn_quality.discounts(np.array(list(table.values()))) for n, table in tables.items()}

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / kn_quality.SYMBOLS
        own = {g: c for g, c in tables[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return probability(gram[1:])
        total = sum(own.values())
        back = sum(taken[n][min(c, 3)] for c in own.values()) / total
        count = own.get(gram, 0)
        return (count - taken[n][min(count, 3)]) / total + back * probability(gram[1:])

    return probability


def test_kneser_ney_matches_brute_force(spark):
    texts = ["the cat sat on the mat", "a dog, a cat; and THE mat 42", "öde Wörter"]
    docs = documents(spark, texts)
    model = kn_quality.count_model(docs.select("lang", "text"))
    exact = kneser_ney_by_brute_force(texts, kn_quality.ORDER)
    seen = "the dog sat on a zzz 7é"
    data = np.frombuffer(seen.encode(), np.uint8)
    got = model.probability(kn_quality.packed_ngrams(data, np.array([0, len(data)])))
    symbols = [0] * (kn_quality.ORDER - 1) + kn_quality.FOLD[data].tolist()
    want = [exact(tuple(symbols[i : i + kn_quality.ORDER])) for i in range(len(data))]
    np.testing.assert_allclose(got, want, rtol=1e-9)
    surprise = model.surprise(kn_quality.packed_ngrams(data, np.array([0, len(data)])))
    np.testing.assert_allclose(surprise, -np.log(want), rtol=1e-6)
    context = symbols[5 : 5 + kn_quality.ORDER - 1]
    total = sum(exact((*context, symbol)) for symbol in range(kn_quality.SYMBOLS))
    assert total == pytest.approx(1.0)


def test_bands_reject_surprising_and_predictable_documents(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))) for _ in range(200)]
    odd = [" ".join("".join(rng.choice("QXZJ#|%9") for _ in range(6)) for _ in range(200)), " ".join(f"e{i % 7}e" * 40 for i in range(60))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in kn_quality.judge(docs).filter("kept").collect()}
    assert kept == set(range(200))
    assert {r.doc_id for r in kn_quality.reject(docs).collect()} == kept


def test_marks_glued_to_words_are_rejected_even_if_common(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(100, 400))) for _ in range(260)]
    glued = set(range(0, 260, 7))
    texts = [" ".join(word + "***" for word in text.split()) if i in glued else text for i, text in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in kn_quality.judge(docs).filter("kept").collect()} == set(range(260)) - glued


def test_verdicts_follow_from_the_bands_of_each_language(spark):
    rng = random.Random(6)
    rows = []
    for lang, letters in (("en", "etaoinshr"), ("de", "enisratdhuü"), (None, "xyzw"), ("one", "qrs")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(200)]
        for i in range(1 if lang == "one" else 40):
            text = " ".join(rng.choice(words) + ("!!!!" if i % 13 == 5 else "") for _ in range(rng.randint(20, 300)))
            rows += [(len(rows), text, lang)] * rng.choice((1, 1, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = kn_quality.judge(docs).collect()
    texts, shapes, kept = {r[0]: r[1] for r in rows}, collections.defaultdict(dict), collections.Counter()
    for r in judged:
        if not r.base_failed:
            shapes[r.lang][texts[r.doc_id]] = (r.log_perplexity, r.word_log_perplexity)
    for r in judged:
        size = len(texts[r.doc_id].encode())
        assert r.word_log_perplexity == pytest.approx(r.log_perplexity * size / r.n_words)
        inside = not r.base_failed
        for place, own in enumerate((r.log_perplexity, r.word_log_perplexity)):
            values = sorted(pair[place] for pair in shapes[r.lang].values())
            if not values:
                continue
            low, middle, high = (values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.25, 0.5, 0.75))
            seen = max((high - low) / (2 * 0.6745), kn_quality.MIN_SPREAD * middle)
            spread = math.hypot(seen, kn_quality.FEW_TEXTS_SPREAD * middle / math.sqrt(len(values)))
            inside &= abs(own - middle) <= kn_quality.BAND * spread * math.sqrt(1 + kn_quality.SHORT_BYTES / size)
        assert r.kept == inside
        kept[inside] += 1
    assert len(judged) == len(rows) and min(kept[True], kept[False]) > 5


def test_quality_of_odd_tables(spark):
    docs = documents(spark, ["w " * 60, None, "x"])
    assert kn_quality.reject(docs).columns == docs.columns
    assert kn_quality.judge(docs.filter("false")).count() == 0
    assert kn_quality.reject(docs.filter("false")).count() == 0
    plain = documents(spark, [" ".join(f"w{i}{j}" for i in range(80)) for j in range(3)]).withColumn("log_perplexity", F.lit("clash"))
    assert kn_quality.reject(plain).count() == 3


@pytest.mark.parametrize("share", [50, 80])
@pytest.mark.parametrize("broadcast", [True, False])
def test_copies_of_one_text_leave_all_verdicts_as_they_are(spark, monkeypatch, share, broadcast):
    if not broadcast:
        monkeypatch.setattr(kn_quality, "BROADCAST_DIGESTS", 0)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))) for _ in range(60)]
    texts += [" ".join("".join(rng.choice("QXZJ#|%9") for _ in range(6)) for _ in range(200))]
    copies = [texts[0]] * (len(texts) * share // (100 - share))
    judged = []
    for rows in (texts, texts + copies):
        docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
        judged.append({r.doc_id: r for r in kn_quality.judge(docs).collect()})
    alone, among = judged
    assert len(among) == len(texts) + len(copies)
    assert [i for i in alone if not alone[i].kept] == [60]
    for i, row in among.items():
        one = alone[i if i < len(texts) else 0]
        assert row.kept == one.kept and row.log_perplexity == pytest.approx(one.log_perplexity, rel=1e-9)


def test_corpus_model_counts_texts_and_leaves_none_out(spark):
    common = ["the cat sat on the mat", "the cat ran to the mat", "the cat lay by the mat"] * 3
    texts = [f"{text} {i}" for i, text in enumerate(common)] + ["QXZJ #|% QXZJ #|%", "QXZJ #|% QXZJ #|%", "", "é"]
    rows = kn_quality.ngram_counts(documents(spark, texts), by_text=True).collect()
    want = collections.Counter()
    for text in set(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        want.update(set(kn_quality.packed_ngrams(data, np.array([0, len(data)])).tolist()))
    assert {r.code: r.n for r in rows} == want
    model = kn_quality.fit_corpus(documents(spark, texts))
    assert set(model.grams[-1].tolist()) == want.keys()


def test_near_duplicates_at_80_percent_match_brute_force(spark):
    texts = varied_texts(seed=8, count=260)
    got = {r.doc_id: r for r in hamming_join.near_duplicates(documents(spark, texts), percent=80).collect()}
    classes, _ = classes_by_brute_force(texts, 80)
    assert classes != classes_by_brute_force(texts)[0]
    assert [got[i].component_id for i in range(len(texts))] == classes
    with pytest.raises(ValueError):
        hamming_join.near_duplicates(documents(spark, texts), percent=79)


def test_layouts_miss_one_pair_in_100_000_at_most():
    for percent, layout in hamming_join.LAYOUTS.items():
        p = (1 - percent / 100) * 255 / 256
        within = sum(math.comb(layout.slots, k) * p**k * (1 - p) ** (layout.slots - k) for k in range(layout.distance + 1))
        assert 1 - within < 1e-5 and layout.slots <= 256


def unlinked_copies(count, edits=7, words=300, seed=9):
    """Texts of one original that differ from each other in about ``2 * edits`` words."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for _ in range(count):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("edits", [4, 7])
def test_work_on_unlinked_near_copies_grows_in_proportion(spark, monkeypatch, edits):
    """Rows handed to the units' tasks for texts within the signatures' distance that are not linked."""
    rows = {}
    for count in (60, 240):
        seen = []
        monkeypatch.setattr(hamming_join, "mixed_units", lambda *args: seen.append(set_units.mixed_units(*args)) or seen[-1])
        texts = unlinked_copies(count, edits)
        got = {r.doc_id: r.component_id for r in hamming_join.near_duplicates(documents(spark, texts), percent=80).collect()}
        assert [got[i] for i in range(count)] == classes_by_brute_force(texts, 80)[0]
        rows[count] = seen[0].count()
    assert rows[240] <= 5 * max(rows[60], 60)


def test_rows_that_repeat_an_id(spark):
    """Many equal rows of one id weigh as one, and texts that share an id link each for itself."""
    text = unlinked_copies(1, 0)[0]
    near, other = text.replace("b100", "changed"), " ".join(f"o{i}" for i in range(50))
    docs = documents(spark, [text] * 50 + [near] * 50 + [other, other, near], ids=[5] * 50 + [6] * 50 + [5, 7, 2])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in hamming_join.near_duplicates(docs).collect()}
    assert got == {(5, 296, 2), (6, 296, 2), (2, 296, 2), (5, 46, 5), (7, 46, 5)}
