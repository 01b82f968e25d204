"""The pipeline's stages on a small table: each takes effect, and edge rows pass through."""
import random

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)], "de": ["".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range(900)]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    item = text("en", 30)
    rows = [(i, text(k, 60), k, f"s{i % 4}", None) for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1], "en", "s1", 1), (101, rows[1][1] + " end", "de", None, None), (102, None, "en", "s1", 0), (103, "1 2 3", None, "s1", 5),
             (104, text("en", 40) + " " + item + " " + text("en", 20), "en", "s2", None), (0, rows[0][1], "en", "s0", None), (None, text("de", 30), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_text_key", F.lit("own")).withColumn("doc", F.lit(1))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from tidemark.operators.ordered import percentile_rank

    ranked = percentile_rank(docs.select("lang", "doc_id"), ["lang"], "doc_id", "pct")  # pinned tables of another caller
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        assert k == 4 or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()))
    everything = sorted(-1 if r[0] is None else r[0] for r in rows)
    assert ranked.count() == len(rows)
    assert kept[0] == [i for i in everything if i not in (102, 103)]
    assert kept[1] == sorted(set(kept[0]) - {100, 101})
    assert kept[2] == [i for i in kept[1] if i != 104]
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, kept[3])) <= 2 and kept[4] == kept[3]
    empty = spark.createDataFrame([], docs.schema if False else "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in names} and "pipeline" in names
