"""The root of a fixed set of digests by a hash written anew for this test: one chunk, word by word, without NumPy."""

import hashlib
import struct

from prismgraph import stored, wire
from prismgraph.functions import encode as e

# Fixed values of BLAKE3: initial words and the order in which a round permutes the message.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)


def one_chunk(message):
    """BLAKE3 of at most 1,024 bytes."""
    assert len(message) <= 1024
    blocks = [message[i : i + 64] for i in range(0, len(message), 64)] or [b""]
    chain = list(IV)
    turn = lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF
    for n, block in enumerate(blocks):
        words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        flags = (n == 0) | (n == len(blocks) - 1) << 1 | (n == len(blocks) - 1) << 3
        v = [*chain, *IV[:4], 0, 0, len(block), flags]
        for _ in range(7):
            for i, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
                for word, first, second in ((words[2 * i], 16, 12), (words[2 * i + 1], 8, 7)):
                    v[a] = v[a] + v[b] + word & 0xFFFFFFFF
                    v[d] = turn(v[d] ^ v[a], first)
                    v[c] = v[c] + v[d] & 0xFFFFFFFF
                    v[b] = turn(v[b] ^ v[c], second)
            words = [words[k] for k in ORDER]
        chain = [v[i] ^ v[i + 8] for i in range(8)]
    return struct.pack("<8I", *chain)


def regions_root():
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    wrapped = lambda tag, x: one_chunk(text(wire.MAGIC) + struct.pack("<I", wire.SCHEMA_VERSION) + text(wire.TAGS[tag]) + x)
    a, b, c, d, f = (wrapped("root_leaf", x) for x in sorted(hashlib.sha256(str(i).encode()).digest() for i in range(5)))
    pair = lambda x, y: wrapped("root_node", x + y)
    return pair(pair(pair(a, b), pair(c, d)), f)


def test_the_root_of_the_regions():
    assert one_chunk(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert all(one_chunk(bytes(range(n % 256)) * 3) == e.blake3(bytes(range(n % 256)) * 3) for n in range(0, 250, 7))
    assert regions_root().hex() == stored.REGIONS_ROOT
