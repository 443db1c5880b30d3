"""Two texts of different length under one id."""

from strata.llm import substring_dedup
from tests.llm import plain


def test_texts_of_different_length_under_one_id(spark):
    say = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [(2, f"{say('x', 5)} {' '.join(say('a', 90).split()[40:])}"), (3, f"{say('b', 25)} {say('y', 30)}"), (1, say("a", 90)), (1, say("b", 25))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    plain.same([tuple(r) for r in substring_dedup.dedup(df).collect()], plain.deduped(rows))
