"""Ids and offsets of the chat encoder, against tokenizers itself."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismgraph.llm.chat import END, SEP, START, chat_tokenizer, encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [START, SEP, END, "<|endoftext|>", "<|", "|>", "<\\|im_end|>", "é", "🙂", "👩‍👩‍👧", "é", "中文", " ", " ", "\x00", " ", "\n\n", "\t", "don't", "Straße 12,345", "ａ", "\U0010ffff"]


def same(text: str) -> None:
    ids, first, past = encoder(BPE)(text)
    e = chat_tokenizer(BPE).encode(text, add_special_tokens=False)
    assert ids.tolist() == e.ids
    assert list(zip(first.tolist(), past.tolist())) == [tuple(x) for x in e.offsets]


@given(st.lists(st.sampled_from(PARTS) | st.text(st.characters(exclude_categories=["Cs"]), max_size=6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_ids_and_offsets_are_those_of_tokenizers(parts):
    same("".join(parts))


@pytest.mark.parametrize("part", [" ", "a", "é", "🙂", "\n", "ab 🙂é\n"])
def test_very_long_texts(part):
    same(START + "user" + SEP + part * 50_000 + END)


def test_ids_after_the_vocabulary():
    ids = encoder(BPE)(START + SEP + END)[0]
    assert ids.tolist() == [chat_tokenizer(BPE).token_to_id(x) for x in (START, SEP, END)] and len(np.unique(ids)) == 3
    random.seed(1)
    same("".join(random.choices(PARTS, k=5000)))
