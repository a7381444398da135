"""Likeness and differing branches of whole Merkle trees."""

import random
from collections import Counter

from waymesh.llm import merkle


def test_one_changed_word_of_a_long_text_counts(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    t = "\n".join(" ".join(words[i : i + 50]) for i in range(0, len(words), 50))
    head, tail = t[: len(t) - len(t) // 3], t[len(t) - len(t) // 3 :]
    other = tail.replace(words[-10], "changed") + " " * len(t)  # the next document: the same last third but one word
    d = spark.createDataFrame([(2, t), (1, other)], "doc_id long, text string")
    got = next(x for x in merkle.edited_likeness(d).collect() if x["doc_id"] == 2)
    edited = head + other[: len(t) // 3]

    def chunks(s):
        return Counter(x for _, ps in merkle.tree(s)[1] for _, ls in ps for x in ls)

    a, b = chunks(t), chunks(edited)
    assert got["near_edited"] == 2 * (a & b).total() / (a.total() + b.total()) and 0.99 < got["near_edited"] < 1
    one = lambda s: merkle.merkle_nodes(spark.createDataFrame([(2, s)], "doc_id long, text string"))
    want = merkle.differing_branches(one(t), one(edited)).where("level > 0").collect()
    assert sorted(got["branches"]) == sorted(str(x["section"]) if x["level"] == 1 else f"{x['section']}/{x['paragraph']}" for x in want) != []


def test_only_equal_texts_are_fully_alike():
    a, b = merkle.tree("x y\nz\n"), merkle.tree("z\nx y\n")
    assert merkle.likeness(a, a) == 1 and 0 < merkle.likeness(a, b) < 1
    assert merkle.branches(a, a) == [] and merkle.branches(a, b) == ["0", "0/0", "0/1"]
