"""Exact deduplication, sharding, mixing and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismgraph.llm.exact_dedup import exact_dedup
from prismgraph.llm.mixing import apply_mix, flight, mix_sources, targets
from prismgraph.llm.packing import Packer, byte_bpe, pack_documents
from prismgraph.llm.sharding import difference, shard_documents
from prismgraph.llm.training_order import materialise, permuted, read_ids, read_slots

BPE = public_tokenizers.path("byte_bpe_50k.json")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, messy, weak):
    """With a digest of two values the bytes alone must tell texts apart; one file a batch makes the state carry over."""
    docs, data, path = messy
    how = {"digest": lambda text: F.crc32(text.cast("binary")) % 2} if weak else {}
    got = exact_dedup(spark, path, files=1, **how).collect()
    groups = defaultdict(list)
    for r in data:
        groups[norm(r[1])].append(r[0])
    assert len(got) == len(data)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    found = defaultdict(list)
    for r in got:
        found[r["text_sha256"]].append(r)
    assert set(found) == set(by_text)
    for sha, rows in found.items():
        ids = by_text[sha]
        known = [i for i in ids if i is not None]
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
        assert {r["keep_id"] for r in rows} == {min(known) if known else None} and {r["group_size"] for r in rows} == {len(ids)}
        assert sum(r["kept"] for r in rows) == 1 and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_dedup_goes_on_from_its_state(spark, messy, tmp_path):
    docs, data, path = messy
    folder = f"file://{tmp_path}/in"
    docs.limit(60).write.parquet(folder)
    first = exact_dedup(spark, folder, checkpoint=f"file://{tmp_path}/cp").count()
    docs.limit(60).write.mode("append").parquet(folder)
    again = exact_dedup(spark, folder, checkpoint=f"file://{tmp_path}/cp")
    assert first == 60 and again.count() == 120 and again.filter("kept").count() <= 60 and again.filter("group_size < 2").isEmpty()


def test_exact_dedup_of_nothing(spark, empty):
    assert exact_dedup(spark, empty[1]).count() == 0


def test_differencing_is_a_partition_and_tight():
    rng = random.Random(3)
    weights = [rng.randint(1, 5000) for _ in range(700)]
    parts, sums = difference([[w] + [0] * 7 for w in weights])
    real = [0] * 8
    for w, p in zip(weights, parts):
        real[p[0]] += w
    assert sorted(real) == sorted(sums) and max(real) - min(real) <= 5
    vectors = [[rng.randint(0, 90) for _ in range(4)] for _ in range(30)]
    parts, sums = difference(vectors)
    real = [0] * 4
    for v, p in zip(vectors, parts):
        assert sorted(p) == [0, 1, 2, 3]
        for j, x in enumerate(v):
            real[p[j]] += x
    assert real == sums
    assert difference([[5, 0]])[1] == [5, 0]


@pytest.mark.parametrize("block", [16_384, 7])
def test_shards(spark, messy, block):
    docs, data, _ = messy
    rows = shard_documents(spark, docs, 8, block_groups=block, slot_rows=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    by = defaultdict(list)
    for r in rows:
        by[bytes(r["digest"])].append(r["shard"])
    assert all(len(set(s)) == 1 for s in by.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    heavy = max(len((r[1] or "").encode()) + 1 for r in data)
    rest = sorted(size.values())[:-1]
    # one text outweighs a shard's share; tiny blocks leave it a little company
    assert max(size.values()) <= heavy + (0 if block > 7 else 2000) and max(rest) - min(rest) <= (60 if block > 7 else 300)


def test_shards_of_nothing_and_levels(spark, empty, messy):
    assert shard_documents(spark, empty[0], 8).count() == 0
    from prismgraph.llm.common import Scratch
    from prismgraph.llm.sharding import assign_groups

    groups = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), (F.col("id") % 97 + 1).alias("weight"))
    got = assign_groups(spark, groups, 4, Scratch(spark, "t"), block_groups=5, fan=4).join(groups, "digest").groupBy("shard").agg(F.sum("weight").alias("w")).collect()
    assert len(got) == 4 and max(r["w"] for r in got) - min(r["w"] for r in got) <= 20


def test_targets():
    assert targets([10, 10], [1, 1]) == [15, 15]
    assert targets([10, 10, 10], [3, 1, 2]) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert sum(targets([100, 1, 5, 0], [3, 1, 2, 3])) == pytest.approx(159) and targets([], []) == []


def test_flight_keeps_totals():
    rng = random.Random(4)
    size = [rng.randint(0, 900) for _ in range(400)]
    prob = [0.37] * 400
    out = flight(prob, size, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(prob)) and sum(a * b for a, b in zip(out, size)) == pytest.approx(sum(a * b for a, b in zip(prob, size)))
    landed = flight(prob, size, random.Random(1), land=True)
    assert set(landed) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(landed, size)) - 0.37 * sum(size)) < 20
    often = np.mean([flight([0.5] * 6, [1, 2, 3, 4, 5, 6], random.Random(i)) for i in range(3000)], axis=0)
    assert np.abs(often - 0.5).max() < 0.04


@pytest.mark.parametrize("block", [16_384, 8])
def test_mix(spark, messy, block):
    docs, data, _ = messy
    rows = mix_sources(spark, docs, block_rows=block).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((r[0], words(r[1]), r[3]) for r in data)
    size = Counter()
    for r in data:
        size[r[3]] += words(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([size[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    big = max(words(r[1]) for r in data)
    for s in order:
        slack = big if any(r[3] == s and words(r[1]) == big for r in data) else 60
        assert abs(taken[s] - want[s]) <= slack
    again = mix_sources(spark, docs.repartition(5), block_rows=block).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mix_sources(spark, docs.limit(0)).count() == 0
    if block > 8:
        copies = apply_mix(docs, mix_sources(spark, docs)).groupBy("doc_id").count().collect()
        expected = Counter()
        for r in rows:
            expected[r["doc_id"]] += r["copies"]
        got = {r["doc_id"]: r["count"] for r in copies}
        ids = Counter(r[0] for r in data)
        assert {k: v for k, v in expected.items() if v and ids[k] == 1} == {k: v for k, v in got.items() if ids[k] == 1}


def test_packer_levels_and_flush():
    rng = random.Random(2)
    windows = []
    p = Packer(64, lambda n, pieces: windows.append(pieces))
    for doc in range(500):
        n = rng.randint(1, 150)
        c = p.count.copy()
        s = n % 64
        if s:
            costs = {0: int(((c[1:64].astype(object) ** 2).sum() + 2 * c[s] + 1))}
            for h in np.flatnonzero(c):
                d = c.copy()
                d[h] -= 1
                if h + s <= 64:
                    if h + s < 64:
                        d[h + s] += 1
                    costs[int(h)] = int((d[1:64] ** 2).sum())
            assert costs[p.level(s)] == min(costs.values())
        p.add(doc, np.arange(n, dtype=np.uint32) + doc * 1000)
    p.flush()
    seen = defaultdict(list)
    for w in windows:
        assert sum(len(x[2]) for x in w) <= 64
        for doc, start, ids, total in w:
            assert ids[0] == doc * 1000 + start
            seen[doc].append((start, len(ids), total))
    for parts in seen.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:])) and sum(n for _, n, _ in parts) == parts[0][2]
    assert sum(sum(len(x[2]) for x in w) < 64 for w in windows) == 1


def test_ids_are_those_of_tokenizers(messy):
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    encode = byte_bpe(BPE)
    hard = ["", " ", "\n\n a\t b", "don't I'll WE'RE", "naïve café 東京 🙂🙂 x", "<|endoftext|> 12 3,456.7", "a" * 500, "\x00\x7f​", "x  y   z \r\n\r\n"] + [r[1] or "" for r in messy[1]]
    assert [encode(t).tolist() for t in hard] == [x.ids for x in reference.encode_batch(hard, add_special_tokens=False)]


def test_pack(messy, empty):
    docs, data, _ = messy
    rows = pack_documents(docs, BPE).collect()
    encode = byte_bpe(BPE)
    want = Counter((r[0], tuple(encode(r[1] or "").tolist()) + (1,)) for r in data)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], tuple(ids.tolist()), r["doc_tokens"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048
    assert sum(len(x) for d in pieces.values() for _, x, _ in d) == sum(len(ids) * n for (_, ids), n in want.items())
    for doc, ids in want:
        if want[doc, ids] == 1 and sum(d == doc for d, _ in want) == 1:
            got = sorted(pieces[doc])
            assert tuple(x for _, part, _ in got for x in part) == ids and {t for _, _, t in got} == {len(ids)}
    assert pack_documents(empty[0], BPE).count() == 0


def test_permutation():
    for domain in (1, 2, 3, 17, 1000, 4097):
        x = np.arange(domain)
        y = permuted(x, domain, 99)
        assert sorted(y) == list(range(domain)) and (permuted(y, domain, 99, inverse=True) == x).all()
    assert (permuted(np.arange(1000), 1000, 1) != permuted(np.arange(1000), 1000, 2)).any()


def test_training_order(spark, messy, empty, tmp_path):
    docs, data, _ = messy
    path = f"file://{tmp_path}/order"
    manifest = materialise(spark, docs, path, BPE, length=64, shard_text_bytes=50_000)
    rows = sorted(read_slots(spark, path, manifest, length=64).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and len({r["index"] for r in rows}) == len(rows)
    encode = byte_bpe(BPE)
    total = sum(len(encode(r[1] or "")) + 1 for r in data)
    assert sum(r["n_tokens"] for r in rows) == total and sum(r["n_tokens"] < 64 for r in rows) <= 3
    shards = {r["shard"]: r for r in manifest.collect()}
    assert len(shards) > 2 and sum(r["records"] for r in shards.values()) == len(rows)
    for r in rows[:: max(1, len(rows) // 20)]:
        s = shards[r["shard"]]
        assert r["offset"] == (r["slot"] - s["first_slot"]) * s["stride"]
        ids = read_ids(s["file"], r["slot"], s["first_slot"], 64)
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["n_tokens"]
    later = read_slots(spark, path, manifest, length=64, from_slot=len(rows) - 7).collect()
    assert sorted(r["slot"] for r in later) == list(range(len(rows) - 7, len(rows)))
    # neither partitions nor their order change what lies at a slot
    for n in (1, 8):
        other = materialise(spark, docs.repartition(n), f"file://{tmp_path}/order{n}", BPE, length=64, shard_text_bytes=50_000, chunk_text_bytes=20_000)
        again = materialise(spark, docs.repartition(5, "text"), f"file://{tmp_path}/again{n}", BPE, length=64, shard_text_bytes=50_000, chunk_text_bytes=20_000)
        same = [sorted(tuple(r) for r in read_slots(spark, at, m, length=64).collect()) for at, m in ((f"file://{tmp_path}/order{n}", other), (f"file://{tmp_path}/again{n}", again))]
        assert same[0] == same[1] and len(same[0]) >= len(rows)
    # the stream in index order is the chunks' documents one after another
    everything = [x for r in sorted(rows, key=lambda r: r["index"]) for x in read_ids(shards[r["shard"]]["file"], r["slot"], shards[r["shard"]]["first_slot"], 64).tolist()]
    assert Counter(everything) == Counter(x for r in data for x in [*encode(r[1] or "").tolist(), 1])
    assert materialise(spark, empty[0], f"file://{tmp_path}/none", BPE).count() == 0


def test_the_mix_is_taken_row_by_row(spark, messy):
    """Rows that lack or repeat an id, of several sources, and rows that agree in id, source and text."""
    import corpus_pipeline as pipeline

    docs, data, _ = messy
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    more = [(None, text(rng.randint(1, 40)), s) for s in ("hot", "s1", "s2", None) for _ in range(25)]
    more += [(7_000 + i % 9, text(rng.randint(1, 40)), f"s{i % 5}") for i in range(60)]
    more += [(None, "the same five words here", "hot")] * 23 + [(8_000, "again the same words", "s1")] * 15 + [(None, None, None)] * 5
    table = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string").repartition(6))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = mix_sources(spark, table, weights=(3, 1, 2), share=1.5, cap=2.0).collect()
    got = Counter()
    for r in pipeline.mix(spark, table, "").collect():
        got[r["source"]] += words(r["text"])
    want = Counter()
    for r in mixed:
        want[r["source"]] += r["taken"]
    assert +got == +want
    big = max(words(r[1]) for r in data)
    for r in mixed:
        slack = big if any(x[3] == r["source"] and words(x[1]) == big for x in data) else 60
        assert abs(got[r["source"]] - r["target"]) <= slack
    rows = Counter((r["doc_id"], r["source"], r["text"]) for r in pipeline.mix(spark, table, "").collect())
    sums, hashes = Counter(), {tuple(r)[:3]: r["h"] for r in table.withColumn("h", F.xxhash64("text")).select("doc_id", "source", "text", "h").collect()}
    for r in mixed:
        sums[r["doc_id"], r["source"], r["text_hash"]] += r["copies"]
    assert Counter({(i, s, hashes[i, s, t]): n for (i, s, t), n in rows.items()}) == +sums
