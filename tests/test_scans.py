import random

from braidlog.operators.scans import placed


def test_places_within_groups_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "", "b"] + ["hot"] * 6), rng.randrange(10**6), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "g string, x long, i long").repartition(7)
    got = placed(table, ["g"], ["x", "i"]).collect()
    want, seen = {}, {}
    for g, _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert {r["i"]: r["place"] for r in got} == want
    assert placed(table.limit(0), ["g"], ["x"]).count() == 0
