"""Every stage of the pipeline against a plain version of it, on a table of its own."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from prismgraph.llm import quality
from test_selection import BPE
from test_similarity import _line_dedup, _near


@pytest.fixture(scope="module")
def labels(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labelled"))
    marks = [(r[0], int(i % 3 > 0), 0) for i, r in enumerate(messy[1]) if r[0] is not None and i % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_quality_keeps_what_scores_well(spark, messy, labels):
    docs = messy[0]
    out = pipeline.classify(spark, docs, labels)
    assert out.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{labels}/labels.parquet"), "quality", learn=~quality.held_out(), sample=4096)
    text = next(c for c in ("scored",) if c not in docs.columns)
    want = quality.score_quality(spark, docs, model, ["doc_id", "text"], text).collect()
    good = Counter((r["doc_id"], r["text"]) for r in want if r[text] >= 0.7)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == good and 0 < sum(good.values()) < len(messy[1])


def test_lines_that_came_before_go(spark, messy):
    docs, data, _ = messy
    data = [r for r in data if r[0] is not None]
    out = pipeline.line_dedup(spark, docs.filter("doc_id is not null"), "")
    want = _line_dedup(data, 5)
    left = Counter()
    for r in data:
        text = None if r[1] is None else want[r[0], r[1]]
        if r[1] is None or text or text == r[1] or not _lost_all(r, data):
            left[r[0], text] += 1
    got = out.collect()
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got) == left
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"])


def _lost_all(row, data):
    """Whether every line of the row goes: its text stays empty with a last line added that no other row has."""
    marked = [(i, f"{t}\nthe only line of its own kind" if (i, t) == (row[0], row[1]) else t) for i, t, *_ in data]
    return _line_dedup(marked, 5)[row[0], f"{row[1]}\nthe only line of its own kind"] == "the only line of its own kind"


def test_one_of_each_group_stays(spark, messy):
    docs, data, _ = messy
    out = pipeline.near_dedup(spark, docs, "")
    _, least, groups = _near(data)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(least[g[0]] for g in groups.values())


def test_sequences_hold_every_id_once(spark, messy):
    docs, data, _ = messy
    reference = Tokenizer.from_file(BPE)
    rows = pipeline.pack(spark, docs, "").collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], ids.tolist()))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and sum(n for _, n in w) <= 2048
    times = Counter(r[0] for r in data)
    for doc_id, text, *_ in data:
        if times[doc_id] == 1:
            want = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
            assert [x for _, part in sorted(pieces[doc_id]) for x in part] == want
    assert sum(len(x) for p in pieces.values() for _, x in p) == sum(len(reference.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in data)
    assert sum(sum(n for _, n in w) < 2048 for w in windows.values()) <= docs.rdd.getNumPartitions()


def test_empty_tables_and_runs_over_all_stages(spark, messy, empty, labels, tmp_path):
    for n, docs in enumerate((empty[0], messy[0].unionByName(messy[0].limit(9)).withColumn("_hash", F.lit(random.Random(1).random())))):
        now, names = docs, docs.columns
        for name, stage in pipeline.STAGES:
            out = stage(spark, now, labels)
            assert name == "pack" or out.columns == names
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert (now.count() > 0) == (n > 0)
