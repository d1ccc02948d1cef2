"""Names that contain one another against all pairs."""

import numpy as np

from retail_spark.plans import recommend as RC


def test_names_by_trigrams_equal_all_pairs(spark):
    rng = np.random.default_rng(4)

    def words(n):
        return ["".join(rng.choice(list("abc "), rng.integers(0, 9))) for _ in range(n)]

    names, entries = [*words(250), "", " ", "A", "ab", "zz", "abz"], [*words(60), "Q", "", "ABC"]
    for catalog in (entries, [e for e in entries if e.strip()], ["xyz"]):
        got = {r["name"]: (r["match"], r["how"]) for r in RC.resolve_names(
            spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e,) for e in catalog], "name string")).collect()}
        clean = lambda s: s.strip(" ").lower()
        for n in set(names):
            same = [e for e in catalog if clean(e) == clean(n)]
            part = [e for e in catalog if clean(e) in clean(n) or clean(n) in clean(e)]
            if same:
                assert got[n][1] == "exact" and got[n][0] in same
            elif part:
                assert got[n] == (min(part), "substring")
            else:
                assert n not in got
