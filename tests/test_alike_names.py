"""Names that are compared, of many that resemble one another by chance."""

import hashlib
import random

from lexfold.operators import entities as E


def test_few_pairs_are_compared_and_none_is_lost(spark):
    r = random.Random(3)
    h = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    entities = [f"a{h(i)[:7]} b{h(i)[7:14]}" for i in range(400)] + ["é", "ab", "abc", "abcd efg", "x" * 40]
    names = []
    for i in range(400):
        n = list(r.choice(entities))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(n) + 1)
            n[k : k + r.randint(0, 1)] = r.choice(["", "a", "7", " "])
        names.append("".join(n))
    frames = [spark.createDataFrame([("p", n) for n in sorted(set(side))], f"kind string, {c} string") for side, c in ((names, "a"), (entities, "b"))]
    got = {(x.a, x.b) for x in E.alike_names(*frames, ["kind"]).collect()}
    want = {(a, b) for a in names for b in entities if a != b and E.ratio(a, b) >= E.RATIO}
    assert want and want <= got and len(got) < 2 * len(want) + 100
