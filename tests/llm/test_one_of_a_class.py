import random
from collections import Counter

from prismgraph.llm.near_dup import keep_one_each


def test_one_document_of_a_class_stays_where_ids_repeat_or_lack(spark):
    rng = random.Random(5)
    words = lambda: [f"w{rng.randrange(9000)}" for _ in range(120)]
    a, b, c, d = words(), words(), words(), words()
    near = lambda t, i: " ".join([*t[:-1], f"x{i}"])
    classes = [
        [(1, near(a, 0)), (1, near(a, 1)), (5, near(a, 2))],  # two texts under the smallest id
        [(1, near(b, 0)), (None, near(b, 1))],  # the same id in another class
        [(None, near(c, 0)), (None, near(c, 1)), (None, near(c, 1))],  # no id at all
        [(7, near(d, 0)), (7, near(d, 0))],
    ]
    alone = [(None, None), (None, None), (None, ""), (3, "")]
    rows = [r for g in classes for r in g]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in keep_one_each(spark, docs).collect()]
    of = {t: n for n, g in enumerate(classes) for _, t in g}
    assert Counter(of[t] for _, t in kept if t) == Counter(range(4))
    assert Counter(i for i, t in kept if t) == Counter([1, 1, None, 7])
    assert Counter(r for r in kept if not r[1]) == Counter(alone)
