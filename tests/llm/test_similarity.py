"""Jaccard join, line deduplication, top-k search, chat formatting, quality scores and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prismgraph.llm.chat import END, LEARNED, SEP, START, chat_tokenizer, escape, format_conversations, masked, read_back, render, unescape
from prismgraph.llm.line_dedup import dedup_lines, smallest_runs
from prismgraph.llm.near_dup import jaccard_join, keep_one_each, least_matches, linked_pairs, shingles, signatures
from prismgraph.llm.quality import fit, held_out, score_quality, train
from prismgraph.llm.topk import BallTree, Best, LOWEST, search, topk_search

BPE = public_tokenizers.path("byte_bpe_50k.json")


def shingle_set(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_shingle_hashes_stand_for_shingles():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " ", "x", "a b c d", "a b c d e"]
    raw = [t.encode() for t in texts]
    sets = shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    for (t, s), (u, v) in combinations(zip(texts, sets), 2):
        a, b = shingle_set(t), shingle_set(u)
        assert len(s) == len(a) and len(np.intersect1d(s, v)) == len(a & b)


@pytest.mark.parametrize("many", [False, True])
def test_pruning_keeps_what_reaches_the_threshold(many):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(400)]
    sets = [np.unique(np.array([x if rng.random() > 0.08 else rng.getrandbits(64) for x in base], np.uint64)) for _ in range(40 if many else 12)]
    sets += [np.unique(np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)) for _ in range(5 if many else 60)]
    sig = signatures(sets)
    left, right = np.triu_indices(len(sets), 1)
    a, b = linked_pairs(sig, sets, left, right, 0.8, least_matches(0.8, 1e-7))
    brute = {(i, j) for i, j in zip(left, right) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a, b)) == brute and brute
    need = least_matches(0.8, 1e-7)
    assert need == sorted(need) and need[0] < 8 and need[-1] < 0.8 * 128


def _near(data):
    sets = [shingle_set(r[1]) for r in data]
    links, parent = Counter(), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(data)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(i)
    least = {i: min((data[j][0] for j in g if data[j][0] is not None), default=None) for g in groups.values() for i in g}
    return links, least, groups


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_join(spark, messy, empty, block):
    docs, data, _ = messy
    got = jaccard_join(spark, docs, block=block).collect()
    links, least, _ = _near(data)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter((r[0], least[i], links[i]) for i, r in enumerate(data))
    if block > 3:
        assert jaccard_join(spark, empty[0]).count() == 0


def test_one_of_each_class_stays(spark, messy):
    docs, data, _ = messy
    kept = keep_one_each(spark, docs)
    assert kept.columns == docs.columns
    _, least, groups = _near(data)
    want = Counter(least[g[0]] if least[g[0]] is not None else None for g in groups.values())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_smallest_runs():
    assert smallest_runs(np.array([9, 1, 0, 8]), 5).tolist() == [[0, 1], [0, 2], [0, 3], [1, 3], [2, 2], [3, 1]]
    assert smallest_runs(np.array([0, 0]), 5).tolist() == [] and smallest_runs(np.array([], int), 5).tolist() == []


def _line_dedup(data, least):
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in data if r[1] is not None}, key=lambda x: x[:2])
    places = defaultdict(list)
    lines = {k: k[2].split("\n") for k in order}
    for k in order:
        for j, x in enumerate(lines[k]):
            places[x].append((k, j))
    rank = {k: i for i, k in enumerate(order)}
    out = {}
    for k in order:
        ls = lines[k]
        gone = [False] * len(ls)
        for i in range(len(ls)):
            best = 0
            for e, m in places[ls[i]]:
                if (rank[e], m) >= (rank[k], i):
                    break
                n = 0
                while i + n < len(ls) and m + n < len(lines[e]) and ls[i + n] == lines[e][m + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.encode().split()) for x in ls[i : i + best]) >= least:
                gone[i : i + best] = [True] * best
        out[k[1] if k[0] else None, k[2]] = "\n".join(x for x, g in zip(ls, gone) if not g)
    return out


@pytest.mark.parametrize("least", [5, 75])
def test_line_dedup(spark, messy, empty, least):
    docs, data, _ = messy
    data = [r for r in data if r[0] is not None]  # rows without an id are ordered by a hash
    got = dedup_lines(spark, docs.filter("doc_id is not null"), least)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    want = _line_dedup(data, least)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], None if r[1] is None else want[r[0], r[1]]) for r in data)
    if least == 5:
        assert dedup_lines(spark, docs).count() == docs.count() and dedup_lines(spark, empty[0]).count() == 0


@pytest.mark.parametrize("least", [5, 75])
def test_line_dedup_of_rows_without_an_id(spark, messy, least):
    """Rows without an id count, before all others, in the order of their texts' hashes."""
    docs, data, _ = messy
    more = [(None, r[1]) for r in data[10:50:5]] + [(None, data[20][1]), (None, "\n".join([data[30][1], data[30][1]])), (None, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [tuple(r) for r in table.withColumn("h", F.xxhash64("text")).collect()]
    stand_in = {t: n - 1000 for n, (_, t) in enumerate(sorted({(h, t) for i, t, h in rows if i is None and t is not None}))}
    want = _line_dedup([(stand_in[t] if i is None and t is not None else i, t) for i, t, _ in rows], least)
    expected = Counter((i, None if t is None else want[stand_in[t] if i is None else i, t]) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["text"]) for r in dedup_lines(spark, table, least).collect()) == expected


def test_line_runs_of_short_lines(spark):
    """Runs that only together have enough words, over blank lines, across several doublings, and inside one document."""
    run = "a b\n\nc\n\n\n\n\n\n\nd e f"
    data = [(1, f"x1 y1 z1 p q\n{run}\nend one of it all"), (2, f"{run}\ntail of two is here"), (3, "a b\n\nc\nother words are in here"), (4, f"{run}\n{run}")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: v for (k, _), v in _line_dedup(data, 5).items()}
    assert got[2] == "tail of two is here" and got[4] == ""


def _best(vectors, k):
    out = []
    whole = [(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        found = sorted(((-sum(a * b for a, b in zip(v, w)), j) for i, v in whole if i == q for j, w in whole if j != q and len(v) == len(w)))[:k]
        out += [(q, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("shard", [16_384, 40])
def test_topk(spark, shard):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * 0.2]) for i in range(300)]
    data += [(1000 + i, data[3][1]) for i in range(30)]  # ties
    data += [(20, data[7][1]), (2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0, 2.0]), (2020, [0.5, -0.5]), (None, [1.0] * 8), (2040, [1e7] * 8), (2041, [1e7] * 8)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<float>, shard string, rank int")
    got = topk_search(spark, table, F.col("vec_id") % 20 == 0, k=7, shard_rows=shard, query_block=8, leaf=10)
    assert sorted(map(tuple, got.collect())) == sorted(_best(data, 7))
    if shard == 40:
        assert topk_search(spark, table.limit(0), F.lit(True)).count() == 0


def test_tree_leaves_out_nodes():
    rng = np.random.default_rng(1)
    vectors = np.floor(64 * (rng.normal(size=(4000, 4)) + rng.integers(0, 9, (4000, 1)) * 8)).astype(np.int64)
    tree = BallTree(np.arange(4000), vectors, 64)
    seen = []
    best = Best(3, 5, np.full(3, LOWEST))
    offer = best.offer
    best.offer = lambda q, s, i: (seen.append(len(q)), offer(q, s, i))
    queries = vectors[:3].astype(float)
    search(tree, np.array([-1, -2, -3]), queries, best)
    assert sum(seen) < 3 * 4000 / 4
    for q in range(3):
        top = sorted(((-int(vectors[q] @ v), i) for i, v in enumerate(vectors)))[:5]
        assert list(zip(best.score[q], best.id[q])) == [(-s, i) for s, i in top]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x", f"{START}user{SEP}{END}", "a < | b", "\\<|\\", "<<||>", "é<|🙂"])
def test_escapes(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_masks_cover_the_learned_texts():
    turns = [("user", "hi"), (LEARNED, "  é🙂 \n<|im_end|> x"), (LEARNED, ""), ("a<|im_sep|>b", "\n"), (LEARNED, "\nend")]
    text, spans = render(turns)
    e = chat_tokenizer(BPE).encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets)
    tokens = masked(spans, offsets[:, 0], offsets[:, 1])
    inside = {t for a, z in tokens for t in range(a, z)}
    assert inside == {t for t, (a, z) in enumerate(e.offsets) if any(a < y and x < z for x, y in spans)}
    assert "".join(unescape(text[a:z]) for a, z in spans) == "  é🙂 \n<|im_end|> x\nend"


@pytest.mark.parametrize("each", [256, 3])
def test_chat(spark, each):
    rng = random.Random(2)
    bad = f"{END}{START}{LEARNED} ok"
    data = [(c, t, rng.choice(["user", LEARNED, "system"]), rng.choice(["", bad, "héllo 🙂", "plain\nlines", "<\\|"]) * rng.randint(1, 3), 1) for c in range(9) for t in range(c + 1)]
    data += [(-1, 0, "user", bad, 1), (-1, 1, LEARNED, bad, 1), (50, 0, LEARNED, None, 1), (51, 0, None, "x", 1), (None, 0, LEARNED, "lost", 1), (52, 3, "user", "b", 1), (52, 3, "user", "a", 1), (52, None, LEARNED, "first", 1), (52, 3, "user", "a", 1)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segment int")
    formatted = format_conversations(spark, table, BPE, turns_each=each)
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in data:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    whole = {}
    for r in sorted(formatted.collect(), key=lambda r: (str(r["conv_id"]), r["segment"])):
        text, ids = whole.get(r["conv_id"], ("", []))
        whole[r["conv_id"]] = text + r["text"], ids + np.frombuffer(r["ids"], "<u4").tolist()
    for c, rows in want.items():
        rows.sort()
        said = "".join(x[3] for x in rows if x[2] == LEARNED)
        r = got[c]
        assert r["n_turns"] == len(rows) and r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] == len(whole[c][0])
        # segments joined are the ids of the whole
        assert whole[c][1] == chat_tokenizer(BPE).encode(whole[c][0], add_special_tokens=False).ids
    if each == 3:
        assert read_back(format_conversations(spark, table.limit(0), BPE)).count() == 0


def test_quality(spark, messy, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "to", "river", "stone", "house", "light"]) for _ in range(60))
    junk = lambda: rng.choice([lambda: " ".join([rng.choice(["spam", "buy"])] * 60), lambda: " ".join(w.upper() + "!!" for w in good().split())])()
    data = [(i, good() if i % 4 else junk(), int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(900, "", "x"), (901, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(7, None, 1), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels, learn=~held_out(), sample=256)
    assert len(model.known) <= 256
    got = {r["doc_id"]: r for r in score_quality(spark, docs, model, ["doc_id"]).withColumn("held", held_out()).collect()}
    held = [i for i, _, _ in data if got[i]["held"]]
    assert len(held) > 50 and all((got[i]["score"] >= 0.7) == bool(data[i][2]) for i in held)
    assert got[900]["score"] == got[901]["score"] == pytest.approx(model.prior) and all(0 <= r["score"] <= 1 for r in got.values())
    shifted = train(docs, labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))), learn=~held_out(), sample=256)
    assert (shifted.known == model.known).all() and (shifted.label == model.label).all()
    none = train(docs, labels.limit(0))
    assert {r["score"] for r in score_quality(spark, docs, none, ["doc_id"]).collect()} == {0.5}
    clash = score_quality(spark, messy[0], model, [c for c in messy[0].columns if c != "score"])
    assert clash.count() == messy[0].count() and score_quality(spark, empty[0], model, ["doc_id"]).count() == 0


def test_quality_of_long_texts_is_that_of_pieces():
    from prismgraph.llm import quality as q

    powers = q._powers(1 << 12)
    text = ("word and more words! " * 900).encode()
    data = np.frombuffer(text, np.uint8)
    whole = q.count_terms(data[:4096], np.array([4096]), powers)
    halves = sum(q.count_terms(data[i : min(4096, i + 2100)], np.array([min(4096, i + 2100) - i]), powers) for i in range(0, 4096, 2100))
    assert np.abs(whole - halves).sum() < 12
    assert fit(np.zeros((0, q.TERMS), np.float32), np.zeros(0)).prior == 0.5


def test_pipeline_stages(spark, messy, tmp_path):
    import corpus_pipeline as pipeline

    docs, data, path = messy
    folder = path.rpartition("/")[0]
    spark.createDataFrame([(r[0], 1, 0) for r in data if r[0] is not None][:60], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "pack":
            assert out.columns == now.columns and [f.dataType for f in out.schema] == [f.dataType for f in now.schema]
        if name == "line_dedup":
            assert all(r["n_chars"] in (None, len(r["text"])) for r in out.collect() if r["text"] is not None)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert now.count() > 0 and set(re.findall(r"\w+", " ".join(now.columns))) >= {"doc_id", "sequence_id", "offset"}
