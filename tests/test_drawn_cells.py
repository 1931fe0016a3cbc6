from sitewise.plans import pipelines


def test_cells_of_one_family_come_from_many_tasks(spark):
    texts = {i: "ABCDEFGH"[i % 5 :] for i in range(200)}
    records = spark.createDataFrame([("f", i, s) for i, s in texts.items()] + [(None, 999, "XY")], "fam string, rec long, seq string")
    drawn = spark.createDataFrame([("f", 0), ("f", 3), ("f", 6), ("g", 1)], "fam string, col int")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        cells = pipelines.drawn_cells(records, drawn, "fam", "rec", "seq")
        sizes = [len(x) for x in cells.rdd.glom().collect()]
        got = sorted(map(tuple, cells.collect()))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert got == sorted(("f", c, s[c]) for s in texts.values() for c in (0, 3, 6) if c < len(s))
    assert max(sizes) < sum(sizes) / 2
