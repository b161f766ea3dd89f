"""The pipeline's stages on a table with planted cases, and the registered queries against their SQL."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from chartmill.llm import packing, poisson_mix  # noqa: E402
from chartmill.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from chartmill.llm.tokens import default_vocabulary, token_ids  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(80, 300))) for _ in range(60)]
    rows = [(i, text, "en", f"s{i % 3}") for i, text in enumerate(clean)]
    rows[5] = (5, clean[5] + " write to jane.doe@mail.example.org today", "en", "s0")
    near = clean[7].split()
    near[3] = "changed"
    rows += [(100, clean[6], "en", "s1"), (101, " ".join(near), "en", "s1"), (102, "too short", "en", "s1"), (103, None, None, None)]
    rows += [(104, "spam spam spam " * 60, "en", "s2")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def test_stages(spark, tmp_path):
    docs = planted(spark)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["quality"]} == {*range(60), 100, 101}
    assert {r.doc_id for r in kept["near_duplicates"]} == {*range(60)}
    texts = {r.doc_id: r.text for r in kept["personal_data"]}
    assert "jane.doe" not in texts[5] and "<EMAIL>" in texts[5] and len(texts) == 60
    assert {r.doc_id: r.text for r in kept["mixing"]}.items() <= texts.items()
    tokens = sum(len(token_ids(r.text, default_vocabulary())) + 1 for r in kept["mixing"])
    assert sum(r.length for r in kept["packing"]) == tokens


def test_extra_columns_with_names_used_inside(spark):
    extra = ["_dropped", "_u", "row", "lang_2", "kept", "node", "label", "Shuffle_Key", "spans"]
    docs = planted(spark)
    for name in extra:
        docs = docs.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs, SF).filter("kept = 'own' AND node = 'own'").count() > 50
    mixed = poisson_mix.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c != "Shuffle_Key"] + ["n_copies", "copy", "shuffle_key"]
    assert packing.pack(docs).count() > 0


def test_empty_and_odd_tables(spark):
    docs = planted(spark)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.filter("false"), SF).collect()
        stage(spark, odd, SF).collect()


def test_registered(spark):
    numbers = sorted(int(key[2:].partition("_")[0]) for key in QUERIES)
    assert numbers == sorted({*range(1, 11), *numbers})
    assert {*QUERIES, "pipeline"} <= __spark_entry__.queries().keys()
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, key):
    got = QUERIES[key](spark, SF)
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(ORACLE_SQL[key])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(
        map(str, want.select(*[f'"{c}"' for c in columns]).fetchall())
    )


def test_near_duplicates_between_80_and_85_percent_go(spark):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    for at in (50, 120, 190, 260, 330, 370, 20, 90):  # 8 edits x 5 of 396 windows: similarity 356 / 436, 0.817
        near[at] = f"other{at}"
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [1]
