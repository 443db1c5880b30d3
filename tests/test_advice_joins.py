"""Pairs of a hot field: whole, each once, and in more than one task."""

from strata.operators import joins


def test_contradictions_of_a_hot_field_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "FIELD_BLOCK", 10, raising=False)
    values = [float(1 + i % 13) for i in range(60)]
    rows = [(i, "hot", i, 1, v, "nm" if i % 3 else "") for i, v in enumerate(values)]
    rows += [(90, "cold", 1, 1, 1.0, "nm"), (91, "cold", 2, 1, 2.0, "nm"), (92, None, 3, 1, 9.0, "nm")]
    df = spark.createDataFrame(rows, "claim int, field string, document int, page int, value double, units string")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.contradictions(df).selectExpr("*", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if abs(values[i] - values[j]) / ((values[i] + values[j]) / 2) > 0.1]
    assert sorted((r.left, r.right) for r in got if r.field == "hot") == want
    assert [(r.left, r.right) for r in got if r.field != "hot"] == [(90, 91)]
    assert len({r.task for r in got if r.field == "hot"}) > 1
