import hashlib

from pyspark.sql import functions as F

from prefmill.functions.derive import settle
from prefmill.functions.keys import dense_index, md5_int, row_count
from prefmill.operators.lookup import skew_safe_join
from prefmill.operators.sampling import (
    collect_samples, draw_with_replacement, expand_samples, pick_per_slot, slots,
)


def h(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_md5_int_matches_python(spark):
    rows = spark.range(50).select("id", md5_int("s", F.col("id"), 3).alias("h")).collect()
    assert all(r["h"] == h("s", r["id"], 3) for r in rows)


def test_dense_index_is_the_rank_of_the_hash(spark):
    for bits in (1, 5, 12):
        df = spark.range(700).withColumnRenamed("id", "k")
        got = {r["k"]: r["idx"] for r in dense_index(df, "k", "seed", bits=bits).collect()}
        order = sorted(range(700), key=lambda k: (h("seed", k), str(k)))
        assert got == {k: i for i, k in enumerate(order)}


def test_dense_index_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"))
    one = dense_index(df.repartition(7), "k", 1).collect()
    two = dense_index(df.coalesce(1), "k", 1).collect()
    assert sorted(one) == sorted(two)
    assert sorted(r["idx"] for r in one) == list(range(300))


def test_dense_index_buckets_stay_even_under_hot_values(spark):
    # the payload may be skewed at will: only the hash of the unique key places a row
    df = spark.range(4000).select("id", F.lit("same").alias("payload"))
    hashed = df.select(F.shiftright(md5_int(1, F.col("id")), 60 - 4).alias("b"))
    counts = [r["count"] for r in hashed.groupBy("b").count().collect()]
    assert len(counts) == 16 and max(counts) < 2 * 4000 / 16


def test_row_count_is_a_scalar_in_the_plan(spark):
    df = spark.range(3).select((F.col("id") + row_count(spark.range(9))).alias("x"))
    assert [r["x"] for r in df.collect()] == [9, 10, 11]


def test_draws_follow_the_hash(spark):
    items = spark.createDataFrame([(10 + i, f"q{i}") for i in range(7)], "conv_id int, query string")
    order = sorted(range(10, 17), key=lambda k: h(42, k))
    got = {r["instance_id"]: r["conv_id"] for r in
           draw_with_replacement(items, "conv_id", 40).collect()}
    assert got == {i: order[h(42, i) % 7] for i in range(40)}
    one = draw_with_replacement(items.limit(1), "conv_id", 5).collect()
    assert len(one) == 5  # one query, drawn again and again


def test_pick_per_slot(spark):
    df = spark.createDataFrame([(5, ["a", "b", "c"]), (6, ["z"]), (7, [])], "k int, v array<string>")
    picked = pick_per_slot(F.col("v"), F.size("v"), 42, F.col("k"), F.col("slot"))
    rows = expand_samples(df, 4, "slot").select("k", "slot", picked.alias("p")).collect()
    values = {5: ["a", "b", "c"], 6: ["z"], 7: []}
    for r in rows:
        expected = values[r["k"]]
        assert r["p"] == (expected[h(42, r["k"], r["slot"]) % len(expected)] if expected else None)


def test_expand_then_collect_keeps_slot_order(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    wide = expand_samples(df, 12).withColumn("text", F.concat_ws("-", "k", "sample_idx"))
    back = collect_samples(wide.repartition(5), "k").collect()
    assert all(r["texts"] == [f"{r['k']}-{i}" for i in range(12)] for r in back)
    assert spark.range(1).select(slots(0).alias("s")).first()["s"] == []


def test_skew_safe_join_with_one_hot_key(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    keys = rows.select("key").distinct()
    table = keys.select("key", F.concat(F.lit("v-"), "key").alias("value")).filter("key <> 'k7'")
    got = skew_safe_join(rows, table, ["key"], "id", hot_rows=100)
    expected = rows.join(table, "key")
    assert sorted(got.select("id", "value").collect()) == sorted(expected.select("id", "value").collect())
    assert got.columns == ["key", "id", "value"]


def test_settle_keeps_filters_above_the_derivation(spark):
    df = spark.range(5).select("id", F.sequence(F.lit(0), F.col("id")).alias("xs"))
    out = settle(df, {"n": F.size(F.filter("xs", lambda x: x % 2 == 0)), "m": F.size("xs")})
    kept = out.filter("n > 1")
    assert sorted((r["id"], r["n"], r["m"]) for r in kept.collect()) == [(2, 2, 3), (3, 2, 4), (4, 3, 5)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert plan.count("filter(xs") == 1
