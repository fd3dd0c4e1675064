"""Operators against plain versions of themselves: votes, chains of weak links, rows without an id, clashing names."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgraph.llm import near_dup, quality
from prismgraph.llm.line_dedup import dedup_lines
from prismgraph.llm.near_dup import jaccard_join, keep_one_each
from prismgraph.llm.mixing import apply_mix, mix_sources
from test_similarity import _near, shingle_set


def _counts(text):
    """Term counts of one text, position by position, without any vectorised step of the operator."""
    raw, out = (text or "").encode(), np.zeros(quality.TERMS)
    wrap = lambda x: x & 0xFFFFFFFF
    c = [int(quality.CLASS[b]) for b in raw]
    for i in range(len(raw) - 2):
        out[wrap(wrap((raw[i] * 65599 + raw[i + 1]) * 65599 + raw[i + 2]) * 0x9E3779B1) >> 21] += 1
    for i in range(len(raw) - 3):
        out[quality.TRIGRAMS + (wrap((c[i] << 12 | c[i + 1] << 8 | c[i + 2] << 4 | c[i + 3]) * 0x9E3779B1) >> 22)] += 1
    words = raw.split()
    for n, w in enumerate(words):
        shout = sum(quality.CLASS[b] == 3 for b in w) * 2 > len(w)
        out[quality.TRIGRAMS + quality.RUNS + shout * 64 + min(len(w).bit_length() - 1, 3) * 16 + int(quality.CLASS[w[-1]])] += 1
        out[-1] += n > 0 and words[n - 1] == w
    return out


def test_scores_are_the_cosine_votes_of_all_labelled_rows(spark, messy):
    docs, data, _ = messy
    labels = spark.createDataFrame([(r[0], i % 3 > 0, 0) for i, r in enumerate(data) if r[0] is not None and i % 2], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int"))
    model = quality.train(docs, labels, learn=~quality.held_out(), sample=10_000)
    ids = {r["doc_id"]: r["quality"] for r in labels.filter(~quality.held_out()).dropDuplicates(["doc_id"]).collect()}
    learned = [r for r in data if r[0] in ids]
    assert len(model.known) == len(learned) and len(learned) > 20

    def latent(text):
        x = np.log1p(_counts(text)) * model.idf
        for (a, z), length in quality.FAMILIES:
            n = np.sqrt((x[a:z] ** 2).sum())
            x[a:z] *= length / n if n else 1
        counts = _counts(text)
        words = counts[quality.TRIGRAMS + quality.RUNS : -1].sum()
        x[-1] = np.sqrt(counts[-1] / max(words, 1))
        z = x @ model.axes
        return z / (np.linalg.norm(z) or 1)

    known, marks = np.array([latent(r[1]) for r in learned]), [ids[r[0]] for r in learned]
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in quality.score_quality(spark, docs, model, ["doc_id"]).collect())
    want = Counter()
    for r in data:
        near = sorted(zip(known @ latent(r[1]), marks), key=lambda p: -p[0])
        near = near[: model.nearest]
        w = [max(s, 0) ** model.power for s, _ in near]
        want[r[0], round(sum(a * m for a, (_, m) in zip(w, near)) / sum(w) if sum(w) > 1e-9 else model.prior, 2)] += 1
    differing = sum((got - want).values())
    assert differing <= 3, (got - want, want - got)  # ties of the last neighbour and rounding


@pytest.mark.parametrize("block", [256, 4])
def test_chains_of_weak_links_are_compared_within_bands(spark, block, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60 * 40)]
    data = [(i, " ".join(words[i * 25 : i * 25 + 90]), None) for i in range(70)]  # each shares much with the next, too little to link
    data += [(100 + i, " ".join([*words[500:700], f"y{i}"]), None) for i in range(9)]  # all alike
    data += [(200, data[3][1], None), (201, " ".join([*words[75:164], "z"]), None)]
    seen = []
    places = near_dup._places

    def watched(*a):
        out = places(*a)
        seen.extend(p["at"] for r in out.collect() for p in r["places"])
        return out

    monkeypatch.setattr(near_dup, "_places", watched)
    got = jaccard_join(spark, spark.createDataFrame(data, "doc_id long, text string, x string"), block=block).collect()
    links, least, _ = _near(data)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter((r[0], least[i], links[i]) for i, r in enumerate(data))
    assert (max(seen) > 0) == (block == 4)  # bands take the place of the long component
    assert sum(links.values()) > 70 and len(shingle_set(data[0][1])) > 80


def test_many_rows_without_an_id_take_linear_time(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))

    def run(pairs):
        texts = [text() for _ in range(pairs)]
        rows = [(None, t) for t in texts] + [(None, f"{t} x") for t in texts] + [(None, texts[0])] * pairs
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.monotonic()
        got = Counter(r["n_links"] for r in jaccard_join(spark, docs).collect())
        assert got == {1: 2 * (pairs - 1), pairs + 1: pairs + 2}
        return time.monotonic() - began

    run(50)
    few, many = run(250), run(4000)
    assert many < 6 * few + 10, (few, many)


def test_helper_names_in_the_input_stay(spark, messy):
    docs, data, _ = messy
    clash = ["_hash", "_runs", "_doc", "_h", "h", "row", "id", "_copies", "_nth", "nth", "copies", "part", "runs", "text_hash", "n_links", "class_id", "node_", "places", "_text_to_score"]
    wide = docs.select("doc_id", "text", "source", *[F.lit(c).alias(c) for c in clash])
    plain = docs.select("doc_id", "text", "source")
    steps = {
        "near": lambda d: keep_one_each(spark, d),
        "lines": lambda d: dedup_lines(spark, d),
        "mix": lambda d: apply_mix(d, mix_sources(spark, d)),
        "quality": lambda d: quality.score_quality(spark, d, quality.fit(np.zeros((0, quality.TERMS), np.float32), np.zeros(0)), d.columns),
    }
    for name, step in steps.items():
        out = step(wide)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in clash), name
        want = step(plain).collect()
        if name != "mix":  # the mix may choose other copies of equal rows
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in want), name
        assert len(rows) == len(want), name
