"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, as `<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>` for each turn, encoded once with
offsets, and the sorted spans of its turns are intersected with the sorted spans of its tokens by binary search. The
three control strings are tokens of their own, so no token reaches across the border of a text. Inside roles and texts
a backslash goes after the `<` of every `<`, backslashes, `|`; taking one away again restores the text.

Conversations of more than `turns_each` turn numbers are rendered, encoded and masked in segments of that many turn
numbers, in many tasks; as every segment begins and ends with a control token, their ids joined are the ids of the whole.

Defined results: rows go by turn, then role, then text; a null turn comes first; a null text or role is empty; a null
conv_id is a conversation of its own; rows that repeat are turns of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN

from prismgraph.llm.packing import byte_ranks

#: Fixed control strings of the template, and the ids they get after the vocabulary of the tokenizer file.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
SEGMENT = "conv_id long, segment long, n_turns int, text string, ids binary, loss_spans binary"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TOKENIZERS: dict[str, object] = {}
_ENCODERS: dict[str, Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def chat_tokenizer(path: str):
    """The file as tokenizers loads it, with the control strings: what decodes the ids, and what `encoder` agrees with."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = False
        tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
        _TOKENIZERS[path] = tokenizer
    return _TOKENIZERS[path]


def encoder(path: str) -> Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """text -> ids, first and past-the-last character of every token. The control strings, and the added tokens of the
    file, are tokens of their own; the ids are those of tokenizers once the control strings are added to its file, and so
    are the offsets: a token that holds a part of a character has the whole of it."""
    if path not in _ENCODERS:
        import tiktoken

        ranks, added = byte_ranks(path)
        after = 1 + max(max(ranks.values()), *added.values())
        special = added | {x: after + i for i, x in enumerate((START, SEP, END))}
        encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        size = np.zeros(1 + max(special.values()), np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            size[i] = len(token)
        names = set(special)

        def encode(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.array(encoding.encode(text, allowed_special=names), np.uint32)
            past = np.cumsum(size[ids])
            first = past - size[ids]
            if not text.isascii():
                begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                character = np.cumsum(begins) - 1  # of each byte
                first, past = character[first], character[past - 1] + 1
            return ids, first, past

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of a run of (role, text), and the spans of the texts to learn, as rows (begin, end)."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def masked(spans: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each span the tokens that it holds, as rows (first token, one past the last); both sides are sorted."""
    first = np.searchsorted(end, spans[:, 0], "right")
    last = np.searchsorted(begin, spans[:, 1], "left")
    return np.stack([first, np.maximum(first, last)], 1)


def _format(path: str):
    def flush(encode, parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        found = []
        for (null_conv, conv, segment), part in rows.groupby(["no_conv", "conv", "segment"], sort=False):
            text, spans = render(list(zip(part["role"], part["text"])))
            found.append((None if null_conv else conv, segment, len(part), text, spans))
        out = []
        for conv, segment, n, text, spans in found:
            ids, first, past = encode(text)
            tokens = masked(spans, first, past)
            # what the mask covers of the text: the tokens' spans, cut to the turns' spans
            some = tokens[:, 1] > tokens[:, 0]
            t, s = tokens[some], spans[some]
            cover = np.stack([np.maximum(s[:, 0], first[t[:, 0]]), np.minimum(s[:, 1], past[t[:, 1] - 1])], 1)
            spans_out = np.concatenate([t, cover], 1).astype("<i8")
            out.append((conv, segment, n, text, ids.astype("<u4").tobytes(), spans_out.tobytes()))
        made = pd.DataFrame(out, columns=["conv_id", "segment", "n_turns", "text", "ids", "loss_spans"])
        made["conv_id"] = made["conv_id"].astype("Int64")
        return made

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        held: list[pd.DataFrame] = []
        last: tuple | None = None
        for frame in frames:
            key = list(zip(frame["no_conv"], frame["conv"], frame["segment"]))
            if held and key[0] != last:
                yield flush(encode, held)
                held = []
            last = key[-1]
            whole = next(i for i in range(len(key), 0, -1) if i == 1 or key[i - 2] != last) - 1  # rows before the last segment
            if whole:
                yield flush(encode, [*held, frame[:whole]])
                held = []
            held.append(frame[whole:])
        if held:
            yield flush(encode, held)

    return run


def format_conversations(spark: SparkSession, turns: DataFrame, tokenizer: str, turns_each: int = 256) -> DataFrame:
    """One row per segment, nearly always a whole conversation: conv_id, segment, n_turns, text (rendered), ids
    (unsigned 32-bit, little-endian), loss_spans (rows of first token, one past the last, first character, one past the
    last, signed 64-bit, one for each learned text that isn't empty, in order)."""
    segment = F.coalesce(F.floor(F.col("turn") / F.lit(turns_each)), F.lit(-(1 << 62))).cast("long")
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        segment.alias("segment"),
        F.col("turn").cast("long").alias("nth"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("no_conv", "conv", "segment").sortWithinPartitions("no_conv", "conv", "segment", "nth", "role", "text")
    return dealt.drop("nth").mapInPandas(_format(tokenizer), SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in order; hashes run on from one to the next, so a conversation of any length needs one segment's memory."""
    now: object = ...
    turns = loss = None
    sums = [0] * 5
    out: list[tuple] = []

    def close() -> None:
        if now is not ...:
            out.append((now, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3], sums[4]))

    def made() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        out.clear()
        return frame

    for frame in frames:
        for conv, text, ids, raw in zip(frame["conv_id"], frame["text"], frame["ids"], frame["loss_spans"]):
            conv = None if pd.isna(conv) else int(conv)
            if now is ... or conv != now:
                close()
                now, turns, loss, sums = conv, hashlib.sha256(), hashlib.sha256(), [0] * 5
            for role, said in _TURN.findall(text):
                turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                sums[0] += 1
            for first, past, a, z in np.frombuffer(raw, "<i8").reshape(-1, 4).tolist():
                said = unescape(text[a:z])
                loss.update(said.encode())
                sums[1] += len(said)
                sums[4] += past - first
            sums[2] += len(text)
            sums[3] += len(ids) // 4
        yield made()
    close()
    yield made()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from formatted text, ids and mask alone."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInPandas(_read_back, DIGEST)
