import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from prismgraph.llm.packing import file_bpe, pack_documents
from prismgraph.llm.training_order import materialise, read_ids, read_slots

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n", "  <|endoftext|>\n\n", "<|endoftext| >", "plain", ""]


def test_ids_are_those_of_the_unmodified_tokenizer(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BPE)
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert want[0] == [64, 220, 50256, 275]
    assert [file_bpe(BPE)(t).tolist() for t in TEXTS] == list(want.values())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in pack_documents(docs, BPE).collect()}
    assert got == {i: [*ids, 1] for i, ids in want.items()}
    path = f"file://{tmp_path}/order"
    manifest = materialise(spark, docs, path, BPE, length=64)
    shards = {r["shard"]: r for r in manifest.collect()}
    rows = sorted(read_slots(spark, path, manifest, length=64).collect(), key=lambda r: r["index"])
    ids = [x for r in rows for x in read_ids(shards[r["shard"]]["file"], r["slot"], shards[r["shard"]]["first_slot"], 64).tolist()]
    assert ids == [x for i in want for x in [*want[i], 1]]
