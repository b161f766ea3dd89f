"""How the sources of a language differ in their words, with strings materialised late.

1. Each batch of documents is reduced, where it is read, to the documents of every term digest; digests in
   enough documents of a language mark a bitmap of fixed size. A digest never has fewer documents than any
   term under it, so no term is lost, and most of a corpus's rare terms go before anything else is done.
2. Each batch is reduced again, for the marked digests, to rows (lang, source, digest, occurrences,
   documents). The first row of a digest in a batch also carries the least and the greatest
   string that had it there. Only the fixed-width columns are shuffled to count, exactly.
3. For the digests kept, the least and greatest strings are brought together. Where
   they differ, several terms share the digest: those terms, and no others, are counted again by their strings.
4. Shares, divergences and ranks are computed on digests. Text is joined
   back to the rows that can still be in the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import sized_broadcast, small_batches, text_of, written
from chartmill.llm.textscan import CHUNK_BYTES, chunks, lowered, span_hashes, spans

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Documents reduced together, unless their texts reach the bound on a batch's bytes first.
BATCH_ROWS = 20_000
#: Bits of a term's digest; tests lower them to make digests clash.
DIGEST_BITS = 64
#: Digests are marked by so many of their bits: 8 MB for any corpus. A full bitmap costs speed only.
BITMAP_BITS = 26
#: A unit of the pairwise sums holds the shares of about so many terms in at most two blocks of sources.
SLICE_TERMS = 4096
BLOCK_SOURCES = 128

# fixed values of the term pattern [^\x00-\x40\x5B-\x60\x7B-\x7F]+: the bytes that end a term
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

KEYS = ["lang", "source", "digest"]


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    return span_hashes(data, start, stop) >> np.uint64(64 - bits)


def _unequal(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which spans a (begin, size) hold other bytes than b."""
    out = a_size != b_size
    todo = np.flatnonzero(~out & (a != b))
    if len(todo):
        size = a_size[todo]
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        differ = data[np.repeat(a[todo], size) + inside] != data[np.repeat(b[todo], size) + inside]
        out[todo] = np.logical_or.reduceat(differ, ends - size)
    return out


def _digest_docs(rows: np.ndarray) -> np.ndarray:
    """The (digest, doc) columns of ``rows``, sorted so and each once; docs must ascend."""
    rows = rows[:, np.argsort(rows[0].view(np.uint64), kind="stable")]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    return rows[:, fresh]


def _combined(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row per (digest, doc), sorted so: counts added, ``low`` and ``high`` the least and greatest string of the digest.

    Rows are (digest, doc, n, low, low_size, high, high_size) in columns; docs must ascend.
    """
    rows = rows[:, np.argsort(rows[0].view(np.uint64), kind="stable")]
    digest, doc, n, low, low_size, high, high_size = rows
    fresh = np.ones(len(digest), bool)
    fresh[1:] = digest[1:] != digest[:-1]
    first = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    lead = first[run]
    differ = _unequal(data, low[lead], low_size[lead], low, low_size)
    differ |= _unequal(data, low[lead], low_size[lead], high, high_size)
    bound = {"low": (low[first].copy(), low_size[first].copy()), "high": (high[first].copy(), high_size[first].copy())}
    last = np.append(first[1:], len(digest))
    for bad in np.unique(run[differ]).tolist():  # several terms under one digest
        begin, end = first[bad], last[bad]
        for name, at, size, pick in (("low", low, low_size, min), ("high", high, high_size, max)):
            best = pick(zip(at[begin:end].tolist(), size[begin:end].tolist()), key=lambda s: data[s[0] : s[0] + s[1]].tobytes())
            bound[name][0][bad], bound[name][1][bad] = best
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(fresh)
    return np.stack(
        [digest[at], doc[at], np.add.reduceat(n, at) if len(at) else n, *(part[run[at]] for pair in bound.values() for part in pair)]
    )


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and text offsets of parts of a chunk; one long text is cut where a term ends."""
    if len(offsets) > 2 or len(data) <= CHUNK_BYTES:
        yield 0, len(data), offsets
        return
    begin = 0
    while begin < len(data):
        end = begin + CHUNK_BYTES
        while end < len(data) and not _SEPARATORS[data[end]]:
            end += 1
        end = min(end, len(data))
        yield begin, end, np.array([0, end - begin], np.int64)
        begin = end


def _digested(texts: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: where they begin in it, lower-cased bytes, and digest, text number, begin, end of their terms."""
    base = 0
    for number, raw, offsets in chunks(texts):
        raw = lowered(raw)
        for begin, end, inner in _pieces(raw, offsets):
            part = raw[begin:end]
            start, stop = spans(part, inner, _SEPARATORS)
            doc = number + np.searchsorted(inner, start, "right") - 1
            yield base + begin, part, _digests(part, start, stop, bits).view(np.int64), doc, start, stop
        base += len(raw)


def batch_terms(texts: pa.Array, bits: int = 64, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of a batch, and its rows as in ``_combined``, one per (digest, text), of the marked digests."""
    data, found = [], [np.zeros((7, 0), np.int64)]
    for base, part, digest, doc, start, stop in _digested(texts, bits):
        data.append(part)
        if marked is not None:
            place = digest & (8 * len(marked) - 1)
            some = np.flatnonzero((marked[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            digest, doc, start, stop = digest[some], doc[some], start[some], stop[some]
        size = stop - start
        rows = _combined(part, np.stack([digest, doc, np.ones_like(doc), start, size, start, size]))
        rows[[3, 5]] += base
        found.append(rows)
    whole = np.concatenate(data) if data else np.zeros(0, np.uint8)
    return whole, _combined(whole, np.concatenate(found, axis=1))


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[np.repeat(at, size) + inside].tobytes()))


def _sorted_by_group(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Rows by (lang, source), the number of each row's group, and the first row of each group."""
    batch = batch.take(pc.sort_indices(batch, sort_keys=[("lang", "ascending"), ("source", "ascending")]))
    fresh = np.ones(len(batch), bool)
    fresh[1:] = False
    for name in ("lang", "source"):
        column = batch.column(name)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
    return batch, np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, digest, docs): in how many rows of a language a digest occurs."""
    small_batches(docs.sparkSession, BATCH_ROWS)
    bits = DIGEST_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = [_digest_docs(np.stack([digest, doc])) for _, _, digest, doc, _, _ in _digested(batch.column("text"), bits)]
            digest, doc = _digest_docs(np.concatenate(parts, axis=1)) if parts else np.zeros((2, 0), np.int64)
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy()[doc]
            order = np.lexsort((lang, digest)) if len(langs.dictionary) > 1 else slice(None)
            digest, lang = digest[order], lang[order]
            fresh = np.ones(len(digest), bool)
            fresh[1:] = (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1])
            at = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[at])), pa.array(digest[at]), pa.array(np.diff(np.append(at, len(digest))))],
                names=["lang", "digest", "docs"],
            )

    return docs.select("lang", "text").mapInArrow(work, "lang string, digest long, docs long").groupBy("lang", "digest").agg(F.sum("docs").alias("docs"))


def marked_digests(docs: DataFrame, min_documents: int) -> np.ndarray:
    """A bitmap, of fixed size, with a bit set for every digest in enough documents of a language."""
    place = F.col("digest").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bitmaps = (
        document_counts(docs)
        .filter(F.col("docs") >= min_documents)
        .select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    marked = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in bitmaps.collect():  # bounded by the bitmap's size
        marked[row.bucket << 12 : (row.bucket + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return marked


def term_rows(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """(lang, source, digest, n, docs, low, high): marked digests of the columns lang, source, text, reduced batch by batch.

    ``low`` and ``high`` are NULL but in one row per language and digest of a batch.
    """
    small_batches(docs.sparkSession, BATCH_ROWS)
    bits, shared = DIGEST_BITS, docs.sparkSession.sparkContext.broadcast(marked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            batch, group, first = _sorted_by_group(batch)
            data, rows = batch_terms(batch.column("text"), bits, shared.value)
            digest, doc = rows[0], rows[1]
            if not len(digest):
                continue
            langs = batch.column("lang").take(pa.array(first))
            lang = langs.dictionary_encode().indices.to_numpy()
            own = group[doc]
            fresh = np.ones(len(digest), bool)
            fresh[1:] = digest[1:] != digest[:-1]
            lead = fresh.copy()
            lead[1:] |= lang[own[1:]] != lang[own[:-1]]
            fresh[1:] |= own[1:] != own[:-1]
            at = np.flatnonzero(fresh)
            leading = lead[at]
            place = pa.array(np.cumsum(leading) - 1, mask=~leading)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(own[at])),
                    batch.column("source").take(pa.array(first[own[at]])),
                    pa.array(digest[at]),
                    pa.array(np.add.reduceat(rows[2], at)),
                    pa.array(np.diff(np.append(at, len(digest)))),
                    _strings(data, rows[3][at[leading]], rows[4][at[leading]]).take(place),
                    _strings(data, rows[5][at[leading]], rows[6][at[leading]]).take(place),
                ],
                names=["lang", "source", "digest", "n", "docs", "low", "high"],
            )

    return docs.mapInArrow(work, "lang string, source string, digest long, n long, docs long, low string, high string")


def exact_rows(docs: DataFrame) -> DataFrame:
    """(lang, source, digest, term, n, docs): the same counts by the terms' strings, for digests that terms share."""
    small_batches(docs.sparkSession)
    bits = DIGEST_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seen = Counter(), Counter()
            for lang, source, text in zip(*(batch.column(name).to_pylist() for name in ("lang", "source", "text"))):
                raw = lowered(np.frombuffer(text.encode(), np.uint8))
                start, stop = spans(raw, np.array([0, len(raw)]), _SEPARATORS)
                words = raw.tobytes()
                own = Counter(words[a:b] for a, b in zip(start.tolist(), stop.tolist()))
                n.update({(lang, source, term): count for term, count in own.items()})
                seen.update((lang, source, term) for term in own)
            if not n:
                continue
            terms = [key[2] for key in n]
            ends = np.cumsum([len(term) for term in terms])
            raw = np.frombuffer(b"".join(terms), np.uint8)
            digest = _digests(raw, np.append(0, ends[:-1]), ends, bits).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0] for key in n]),
                    pa.array([key[1] for key in n]),
                    pa.array(digest),
                    pa.array([term.decode() for term in terms]),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([seen[key] for key in n], pa.int64()),
                ],
                names=["lang", "source", "digest", "term", "n", "docs"],
            )

    return docs.mapInArrow(work, "lang string, source string, digest long, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Occurrences (lang, source, digest, split, n) of the kept terms, and their texts (lang, digest, low).

    ``split`` is the term itself where several share a digest, else empty.
    """
    rows = written(term_rows(docs, marked_digests(docs, min_documents)), "terms")
    counts = rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # both sides of the join, and the written table, use all columns of ``counts``: its shuffle is made once
    enough = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("all_n"))
    enough = enough.filter(F.col("all_docs") >= min_documents)
    kept = written(counts.join(enough, ["lang", "digest"]).select(*KEYS, "n", "docs", "all_n"), "kept")
    texts = (
        rows.filter("low IS NOT NULL")
        .groupBy("lang", "digest")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .join(kept.select("lang", "digest").distinct(), ["lang", "digest"], "left_semi")
    )
    texts = written(texts, "texts")
    shared = written(texts.filter("low <> high").select("lang", "digest"), "shared")
    kept = kept.select(*KEYS, F.lit("").alias("split"), "n")
    if shared.isEmpty():
        return kept, texts
    shared = sized_broadcast(shared)
    apart = (
        exact_rows(docs)
        .join(shared, ["lang", "digest"], "left_semi")
        .groupBy(*KEYS, "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    apart = written(apart, "apart")
    enough = apart.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_documents)
    apart = apart.join(enough.select("lang", "term"), ["lang", "term"]).select(*KEYS, F.col("term").alias("split"), "n")
    return written(kept.join(shared, ["lang", "digest"], "left_anti").unionByName(apart), "kept"), texts


def _share(n: str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 5) / (size + 5 * terms)), in decimals: exact at any count."""
    return F.expr(
        f"1L + CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTHING} AS DECIMAL(20,0))"
        f" div CAST({size} + {SMOOTHING} * {terms} AS DECIMAL(20,0))"
    )


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, number, sources, terms, size, lang_size, absent) of every group; ``absent`` is the share of a term it lacks."""
    groups = docs.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = kept.groupBy("lang", "digest", "split").agg(F.sum("n").alias("n")).groupBy("lang")
    terms = terms.agg(F.count("*").alias("terms"), F.sum("n").alias("lang_size"))
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = {"size": 0, "terms": 0, "lang_size": 0}
    sized = groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").join(many, "lang").fillna(zero)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    absent = F.when(F.col("terms") > 0, _share("0", "size", "terms"))
    return sized.withColumn("number", number.cast("int")).withColumn("absent", absent)


def shares(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """``kept`` with each group's figures and the share ``p`` of the term in it."""
    return kept.join(sized_broadcast(sized), ["lang", "source"]).withColumn("p", _share("n", "size", "terms"))


def _unit_sums(unit: pd.DataFrame) -> pd.DataFrame:
    """Differences of all sources of one block, or of two blocks against each other, over the terms that occur here."""
    lang, first, second = unit["lang"].iloc[0], unit["first"].iloc[0], unit["second"].iloc[0]
    blocks = unit[unit["header"]].sort_values("number")
    rows = unit[~unit["header"]]
    numbers, absent = blocks["number"].to_numpy(), blocks["p"].to_numpy(np.int64)
    term = rows.groupby(["digest", "split"]).ngroup().to_numpy()
    grid = np.tile(absent, (int(term.max()) + 1 if len(term) else 0, 1))
    grid[term, np.searchsorted(numbers, rows["number"].to_numpy())] = rows["p"].to_numpy(np.int64)
    block = blocks["own"].to_numpy()
    out = []
    for at in np.flatnonzero(block == first):
        others = np.flatnonzero(block == second)
        others = others[others > at]
        sums = np.abs(grid[:, others] - grid[:, at : at + 1]).sum(0)
        out.append(pd.DataFrame({"a": numbers[at], "b": numbers[others], "part": sums}))
    found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "part": []})
    return found.assign(lang=lang, present=len(grid))[["lang", "a", "b", "part", "present"]]


def pair_sums(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, a, b, value): summed differences of each two sources (by number, a < b) of a language, over all its kept terms.

    A term that neither of two sources has counts by their shares of absent
    terms. Work is cut by terms and by blocks of sources: no task holds more than a slice of two blocks.
    """
    blocks = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int")
    slices = F.ceil(F.col("terms") / SLICE_TERMS).cast("int")
    own = F.floor(F.col("number") / BLOCK_SOURCES).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = rows.select(
        "lang", "digest", "split", "number", "p", own.alias("own"), other, F.pmod(F.xxhash64("digest", "split"), slices).cast("int").alias("slice")
    ).withColumn("header", F.lit(False))
    headers = (
        sized.filter("terms > 0")
        .select("lang", "number", F.col("absent").alias("p"), own.alias("own"), slices.alias("slices"), other)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        .select("lang", F.lit(0).cast("long").alias("digest"), F.lit("").alias("split"), "number", "p", "own", "other", "slice")
        .withColumn("header", F.lit(True))
    )
    units = placed.unionByName(headers).withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    sums = (
        units.groupBy("lang", "slice", "first", "second")
        .applyInPandas(_unit_sums, "lang string, a int, b int, part long, present long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("part").alias("part"), F.sum("present").alias("present"))
    )
    one = sized.select("lang", "terms", F.col("number").alias("a"), F.col("source").alias("source_a"), F.col("absent").alias("absent_a"))
    two = sized.select("lang", F.col("number").alias("b"), F.col("source").alias("source_b"), F.col("absent").alias("absent_b"))
    # the result has a row for each two sources of a language, with or without terms
    pairs = one.join(two, "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.expr("coalesce(part, 0L) + coalesce((terms - present) * abs(absent_a - absent_b), 0L)")
    return pairs.select("lang", "source_a", "source_b", value.alias("value"))


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and by which words.

    Terms are runs of A-Z (lower-cased), a-z and all characters from U+0080 on; those in at least
    ``min_documents`` rows of their language are kept. In part ``pair`` item is another source and
    value the summed difference of the kept terms' shares; all ranks. In part
    ``term`` item is a kept term that has a greater share here than in the language, value by how
    much; ranks to ``top``. Ties go to the lesser item in UTF-8.

    NULL text, language and source count as empty. Every row is a document,
    repeated ones too. A text without terms counts for its group's existence; a language
    without kept terms has pairs of value 0. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    kept, texts = kept_counts(docs, min_documents)
    sized = written(group_sizes(docs, kept), "groups")
    rows = written(shares(kept, sized).select("lang", "source", "number", "digest", "split", "n", "p", "sources", "terms", "lang_size"), "shares")

    sums = written(pair_sums(rows, sized), "pairs")
    both = sums.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").union(
        sums.select("lang", F.col("source_b"), F.col("source_a"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    totals = rows.groupBy("lang", "digest", "split", "terms", "lang_size").agg(F.sum("n").alias("total"))
    totals = totals.select("lang", "digest", "split", _share("total", "lang_size", "terms").alias("q"))
    above = rows.join(totals, ["lang", "digest", "split"]).filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    best = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    candidates = above.select("lang", "source", "digest", "split", "value", best.alias("at")).filter(F.col("at") <= top)
    named = candidates.join(texts.select("lang", "digest", "low"), ["lang", "digest"]).withColumn(
        "item", F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split"))
    )
    terms = named.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.union(terms.filter(F.col("rank") <= top))
