"""Names within an edit distance against all pairs."""

from strata.operators import lookup


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_f1_similar_names_as_all_pairs_and_never_broadcast(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "abcd", "bacd", "abdc", "badc", "xbcy", "axyd", "abab", "baba", "aabb", "Abcde", "bcdea", "éßab", "abéß", "aaaa", "aa"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "n string")
    found = lookup.similar_names(df, df, "n", most=100)
    got = {(r.name, r.candidate): r.distance for r in found.collect()}
    every = {(a, b): _distance(a.lower(), b.lower()) for a in words for b in words}
    assert got == {k: d for k, d in every.items() if d <= 2}
    one = {(r.name, r.candidate) for r in lookup.similar_names(df, df, "n", distance=1, most=100).collect()}
    assert one == {k for k, d in every.items() if d <= 1}
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
