"""The set root of a column of digests: distinct, sorted, wrapped, joined pairwise, an odd one moving up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgraph.functions import encode as e
from prismgraph.functions.blake3 import blake3_many
from prismgraph.operators.ranks import numbered
from prismgraph.scratch import Scratch

#: Leaves of a block that one task reduces; blocks are aligned, so their roots are nodes of the whole tree.
BLOCK = 1 << 16
#: Leaves that the driver reduces alone (32 bytes each).
ALONE = 1 << 18


def _reduce(level: list[bytes]) -> bytes:
    while len(level) > 1:
        joined = blake3_many([e.meta_header("root_node") + a + b for a, b in zip(level[::2], level[1::2])])
        level = joined + level[len(joined) * 2 :]
    return level[0]


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    leaves = [bytes(x) for x in rows.sort_values("at")["leaf"]]
    return pd.DataFrame({"block": [key[0]], "root": [_reduce(blake3_many([e.meta_header("root_leaf") + x for x in leaves]))]})


def set_root(digests: DataFrame, column: str, alone: int = ALONE, block: int = BLOCK) -> tuple[bytes, int]:
    """The root and the number of distinct leaves."""
    leaves = digests.select(F.col(column).alias("leaf")).distinct()
    first = [bytes(r[0]) for r in leaves.limit(alone + 1).collect()]
    if len(first) <= alone:
        return e.set_root(first), len(first)
    scratch = Scratch(digests.sparkSession, "root")
    ranked = scratch.write(numbered(leaves, ["leaf"], "at", scratch), "ranked")
    total = ranked.count()
    blocks = ranked.groupBy(F.floor(F.col("at") / block).alias("block")).applyInPandas(_block, "block long, root binary")
    roots = [bytes(r["root"]) for r in sorted(blocks.collect(), key=lambda r: r["block"])]  # one row per 65,536 leaves
    scratch.drop()
    return _reduce(roots), total
