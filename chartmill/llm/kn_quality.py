"""Quality rules: text statistics, and n-gram perplexity inside language-specific bands.

The language model is a modified Kneser-Ney model of order 4 over characters
folded to 64 classes (``FOLD``): Spark counts the n-grams of all documents, the
counts become sorted arrays of packed n-grams with their probabilities and
back-off weights. An n-gram packs into 24 bits, so however large the corpus, the
model has at most 64^4 entries; its size is bounded, and it is broadcast.

Perplexities are judged within each language, by byte and by word: documents outside a band around the language's
middle, as wide as a multiple of its spread, are rejected, the too surprising as well
as the too predictable ones. Marks glued to every word are common enough in a corpus with much junk to be predictable
byte by byte, but make its words far dearer than words are. Short texts scatter more, so the bands widen with
1 / length. What is common junk would teach the model to expect it by sheer repetition; so the model of
a corpus counts in how many texts an n-gram occurs, over all texts.

Copies weigh once: n-grams, middles and spreads are those of the distinct texts, though every row is judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.llm.common import col, sized_broadcast, small_batches, text_of, written
from chartmill.llm.textscan import chunks, windows, word_hashes

ORDER = 4
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
#: Half the width of a band in robust standard deviations of the language's log-perplexities.
BAND = 6.0
#: A text of this many bytes has a variance twice as large as that of an endless one.
SHORT_BYTES = 1000.0
#: Least deviation of a language's log-perplexities, as a part of their middle.
MIN_SPREAD = 0.003
#: What n distinct texts leave unknown of a language, as a part of the middle: this over the root of n.
FEW_TEXTS_SPREAD = 0.1
#: The perplexities that have a band in each language.
MEASURES = ("log_perplexity", "word_log_perplexity")
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOL_CHARACTERS = b"#*$%&|<>"
#: Digests of texts with copies that are broadcast to weigh rows; beyond it, texts are shuffled and reduced to distinct ones.
BROADCAST_DIGESTS = 1_000_000

_MASK = [(1 << (SYMBOL_BITS * n)) - 1 for n in range(ORDER + 1)]


def _fold() -> np.ndarray:
    """Class of each byte: letters, one for capitals, one for digits, space, breaks, punctuation; the rest shares.

    Class 0 stands for the beginning of a text.
    """
    table = np.zeros(256, np.uint32)
    for place, byte in enumerate(range(ord("a"), ord("z") + 1)):
        table[byte] = 1 + place
        table[byte - 32] = 27
    table[ord("0") : ord("9") + 1] = 28
    table[ord(" ")] = 29
    table[[9, 10, 11, 12, 13]] = 30
    for place, byte in enumerate(b".,;:!?'\"-()"):
        table[byte] = 31 + place
    for byte in range(256):
        if byte >= 192:
            table[byte] = 58 + byte % 6
        elif byte >= 128:
            table[byte] = 46 + byte % 12
        elif table[byte] == 0:
            table[byte] = 42 + byte % 4
    return table


FOLD = _fold()


def packed_ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of a chunk the packed n-gram that ends there; a text's first ones begin with class 0."""
    symbols = FOLD[data]
    code = symbols.copy()
    for back in range(1, ORDER):
        code[back:] |= symbols[:-back] << np.uint32(SYMBOL_BITS * back)
        for place in range(back):  # reaches back over the beginning of a text
            at = offsets[:-1] + place
            at = at[at < offsets[1:]]
            code[at] &= np.uint32(_MASK[back])
    return code


@dataclass
class KneserNey:
    """Per order n (1 to ``ORDER``): sorted n-grams, their probabilities, sorted contexts, their back-off weights."""

    grams: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    table: np.ndarray | None = None

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """Negative log-probabilities; a worker spreads the highest order's array out once, at most 64 MB, to look codes up."""
        if self.table is None:
            self.table = np.full(1 << (SYMBOL_BITS * ORDER), np.nan, np.float32)
            self.table[self.grams[-1]] = -np.log(self.probabilities[-1])
        out = self.table[codes].astype(np.float64)
        unseen = np.flatnonzero(np.isnan(out))
        if len(unseen):
            out[unseen] = -np.log(self.probability(codes[unseen]))
        return out

    def probability(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probability of each packed n-gram's last symbol after the others."""
        if order == 0:
            return np.full(len(codes), 1.0 / SYMBOLS)
        grams = self.grams[order - 1]
        if not len(grams):
            return self.probability(codes & _MASK[order - 1], order - 1)
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        out = self.probabilities[order - 1][at]
        unseen = np.flatnonzero(grams[at] != codes)
        if len(unseen):
            codes = codes[unseen]
            contexts = self.contexts[order - 1]
            before = codes >> SYMBOL_BITS
            place = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
            weight = np.where(contexts[place] == before, self.backoffs[order - 1][place], 1.0)
            out[unseen] = weight * self.probability(codes & _MASK[order - 1], order - 1)
        return out


def weighed_texts(docs: DataFrame) -> DataFrame:
    """(text, copies): in the sum of 1 / copies, each distinct text of documents (text) counts once.

    Texts stay where they are read, with the number of their copies, if those with copies are few enough to broadcast
    their digests. Else they are reduced to distinct ones, by each task before the shuffle, with 1 as the number.
    """
    docs = docs.select("text")
    named = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copied = written(named.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copied")
    if copied.count() > BROADCAST_DIGESTS:
        return docs.distinct().withColumn("copies", F.lit(1).cast("long"))
    return named.join(F.broadcast(copied), "digest", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))


def ngram_counts(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """(code, n): how often each packed n-gram occurs in the distinct texts of all documents (text), or in how many of them."""
    small_batches(docs.sparkSession)

    def merged(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(place, np.concatenate(counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for first, data, offsets in chunks(batch.column(0)):
                found = packed_ngrams(data, offsets)
                own = copies[first : first + len(offsets) - 1]
                text = np.repeat(np.arange(len(own)), np.diff(offsets))
                if by_text:
                    once = np.unique((text << (SYMBOL_BITS * ORDER)) | found)
                    text, found = once >> (SYMBOL_BITS * ORDER), (once & _MASK[ORDER]).astype(np.uint32)
                own = own[text]
                for number in np.unique(own):
                    code, n = np.unique(found[own == number], return_counts=True)
                    codes.append(code)
                    counts.append(n / number)
            if len(codes) > 64:
                codes, counts = ([x] for x in merged(codes, counts))
        if codes:
            code, n = merged(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], names=["code", "n"])

    partial = weighed_texts(docs).mapInArrow(work, "code int, n double")
    # shares of copies add up to whole numbers but for the last bits
    return partial.groupBy("code").agg(F.round(F.sum("n")).cast("long").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts of modified Kneser-Ney for counts of 0, 1, 2 and 3 or more."""
    ones, twos, threes, fours = (int((counts == n).sum()) for n in (1, 2, 3, 4))
    if not ones or not twos:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = ones / (ones + 2 * twos)
    following = [ones, twos, threes, fours]
    found = [n - (n + 1) * y * following[n] / max(following[n - 1], 1) for n in (1, 2, 3)]
    return np.array([0.0] + [min(max(d, 0.05), n - 0.05) for n, d in zip((1, 2, 3), found)])


def fit(codes: np.ndarray, counts: np.ndarray) -> KneserNey:
    """The model of n-gram counts. Lower orders count in how many different contexts a gram occurs."""
    order = np.argsort(codes)
    grams, tallies = {ORDER: codes[order]}, {ORDER: counts[order]}
    for n in range(ORDER - 1, 0, -1):
        grams[n], tallies[n] = np.unique(grams[n + 1] & _MASK[n], return_counts=True)
    model = KneserNey([], [], [], [])
    for n in range(1, ORDER + 1):
        gram, tally = grams[n], tallies[n]
        taken = discounts(tally)[np.minimum(tally, 3)]
        contexts, begin, place = np.unique(gram >> SYMBOL_BITS, return_index=True, return_inverse=True)
        total = np.add.reduceat(tally, begin).astype(float) if len(gram) else np.zeros(0)
        backoff = np.add.reduceat(taken, begin) / total if len(gram) else np.zeros(0)
        lower = model.probability(gram & _MASK[n - 1], n - 1)
        model.grams.append(gram)
        model.probabilities.append((tally - taken) / total[place] + backoff[place] * lower)
        model.contexts.append(contexts)
        model.backoffs.append(backoff)
    return model


def mean_surprise(model: KneserNey, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text of a chunk: the mean negative log-probability of its bytes (0 for none), and their number."""
    size = np.diff(offsets)
    total = np.concatenate([[0.0], np.cumsum(model.surprise(codes))])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1), size


def count_model(docs: DataFrame, by_text: bool = False) -> KneserNey:
    """Count with Spark; the at most 64^4 distinct n-grams then make the model on the driver."""
    table = ngram_counts(docs, by_text).toArrow()
    return fit(table.column("code").to_numpy().astype(np.uint32), table.column("n").to_numpy())


def fit_corpus(docs: DataFrame) -> KneserNey:
    """The model of a corpus (text): in how many of all its distinct texts each n-gram occurs."""
    return count_model(docs, by_text=True)


def digests(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Digest of each text of a chunk."""
    cuts = offsets.tolist()
    return pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:])], pa.binary())


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text of a chunk: words, code points in words, symbol characters, repeated lines, repeated words."""
    count = len(offsets) - 1
    words, at = word_hashes(data, offsets, lower=False)
    marks = np.zeros(256, np.int8)
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    inside[128:192] = False  # continuation bytes: a code point counts at its first byte
    marks[list(SYMBOL_CHARACTERS)] = 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    lines, repeated = np.zeros(count, np.int64), np.zeros(count, np.int64)
    triples = windows(words, 3)
    for place, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if end - begin >= 4:
            own = triples[begin : end - 2]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                covered = np.zeros(end - begin, bool)
                for shift in range(3):
                    covered[shift : shift + len(own)] |= twice
                repeated[place] = int(covered.sum())
        text = data[offsets[place] : offsets[place + 1]].tobytes()
        if b"\n" in text:
            filled = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
            lines[place] = len(filled) - len(set(filled))
    return [np.diff(at), per_text(inside[data]), per_text(marks[data]), lines, repeated]


#: The base rules, on the text statistics.
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(rows: DataFrame, model: KneserNey, text_field: int | None = None) -> DataFrame:
    """Adds to each row the text statistics, n_bytes, the text's digest and log_perplexity.

    The text is the last column and is not returned; or, with ``text_field``, that field of the
    only column, a struct. log_perplexity is the mean negative log-probability per byte; NULL for empty texts.
    """
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    carried = rows.columns if text_field is not None else rows.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carried)) if text_field is None else batch.column(0).field(text_field)
            for first, data, offsets in chunks(texts):
                mean, size = mean_surprise(shared.value, packed_ngrams(data, offsets), offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, len(size)) for i in range(len(carried))]
                    + [pa.array(column.astype(np.int64)) for column in text_statistics(data, offsets)]
                    + [pa.array(size.astype(np.int64)), digests(data, offsets), pa.array(mean, mask=size == 0)],
                    names=[*carried, *STATISTICS, "n_bytes", "digest", "log_perplexity"],
                )

    schema = T.StructType([rows.schema[name] for name in carried])
    for name in (*STATISTICS, "n_bytes"):
        schema = schema.add(name, "long")
    schema = schema.add("digest", "binary").add("log_perplexity", "double")
    return rows.mapInArrow(work, schema).withColumn("base_failed", F.expr(BASE_FAILED))


def bands(scores: DataFrame) -> DataFrame:
    """(lang, and for each of ``MEASURES`` its middle_ and spread_) for each language, NULL being one: median and robust deviation.

    They are those of the distinct texts of the scores (lang, digest, measures). Quantiles are sketched, so a language with most of the rows is summed up by every task, not gathered in one.
    """
    texts = scores.groupBy("lang", "digest").agg(*[F.min(name).alias(name) for name in MEASURES])
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quantiles = texts.groupBy("lang").agg(
        F.count("*").alias("texts"), *[F.percentile_approx(name, quarters, 10_000).alias(name) for name in MEASURES]
    )

    def spread(name: str) -> Column:
        q = F.col(name)
        # a quarter of a normal distribution lies beyond 0.6745 standard deviations on either side
        seen = F.greatest((q[2] - q[0]) / (2 * 0.6745), q[1] * MIN_SPREAD)
        return F.sqrt(seen * seen + q[1] * q[1] * FEW_TEXTS_SPREAD**2 / F.col("texts"))

    limits = [limit for name in MEASURES for limit in (F.col(name)[1].alias(f"middle_{name}"), spread(name).alias(f"spread_{name}"))]
    return quantiles.select("lang", *limits)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    model: KneserNey | None = None,
    band: float = BAND,
) -> DataFrame:
    """Every document's statistics, perplexity and verdict.

    Columns: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    log_perplexity, word_log_perplexity, base_failed, kept. Words are runs of characters other than space and U+0009 to U+000D.
    A document fails the base rules with fewer than ``MIN_WORDS`` words or with more than
    ``MAX_REPEATED_PERCENT`` percent of its words in three-word windows that occur twice;
    it is kept if it passes them and its log-perplexities, by byte and by word, lie in its language's bands.
    NULL text counts as empty, NULL as a language of its own; repeated rows get equal
    results; other columns are not read; an empty table gives no rows.
    Without a ``model``, one is fitted on all of ``docs``. Copies of a text shape model and bands like one row.
    """
    source = docs.select(
        col(id_col).cast("long").alias("doc_id"), col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")
    )
    scores = written(scored(source, model or fit_corpus(source)), "scores")
    return with_verdicts(scores, band).select("doc_id", "lang", *STATISTICS, *MEASURES, "base_failed", "kept")


def with_verdicts(scores: DataFrame, band: float = BAND) -> DataFrame:
    """Adds ``word_log_perplexity`` (NULL without words) and ``kept`` to a written table of scores with a column lang.

    Only what passes the base rules shapes the bands.
    """
    by_word = F.col("log_perplexity") * F.col("n_bytes") / F.nullif(F.col("n_words"), F.lit(0))
    scores = scores.withColumn("word_log_perplexity", by_word)
    good = scores.filter("NOT base_failed AND log_perplexity IS NOT NULL")
    limits = written(bands(good).withColumnRenamed("lang", "band_lang"), "bands")
    wider = F.sqrt(1 + SHORT_BYTES / F.greatest(F.col("n_bytes"), F.lit(1)))
    inside = [
        F.abs(F.col(name) - F.col(f"middle_{name}")) <= F.lit(band) * F.col(f"spread_{name}") * wider for name in MEASURES
    ]
    joined = scores.join(sized_broadcast(limits), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside[0] & inside[1], F.lit(True)))


def reject(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model: KneserNey | None = None, band: float = BAND
) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all columns as they are.

    Rows travel through the scoring whole and wait in the shared folder for their language's band: texts are
    not shuffled, and rows that share an id are judged apart.
    """
    model = model or fit_corpus(docs.select(text_of(text_col).alias("text")))
    rows = docs.select(F.struct(*[col(name) for name in docs.columns]).alias("row"))
    scores = written(scored(rows, model, docs.columns.index(text_col)), "scored_rows")
    judged = with_verdicts(scores.withColumn("lang", F.col("row")[lang_col].cast("string")), band)
    return judged.filter("kept").select("row.*")
