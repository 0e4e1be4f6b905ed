import re

from pyspark.sql import functions as F

from docketry.llm import mixing


def water(sizes, weights, share=1.5, most=2.0):
    asked, level = share * sum(sizes), 0.0
    for _ in range(200):
        full = [level * w >= most * s for s, w in zip(sizes, weights, strict=True)]
        free = sum(w for f, w in zip(full, weights, strict=True) if not f)
        if not free:
            break
        level = (asked - sum(most * s for f, s in zip(full, sizes, strict=True) if f)) / free
    return [min(level * w, most * s) for s, w in zip(sizes, weights, strict=True)]


def check(frame):
    rows = mixing.mixed(frame).collect()
    assert len(rows) == frame.count()
    size = {}
    for r in frame.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    want = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    return rows, want


def test_targets_and_takings(docs):
    rows, want = check(docs)
    assert abs(sum(want.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    for s, target in want.items():
        own = [r for r in rows if r["source"] == s]
        # Documents are taken whole, so a source of a few can miss by up to half of its largest one.
        assert abs(sum(r["taken"] for r in own) - target) <= max(0.03 * target, max(r["size"] for r in own) / 2)


def test_reruns_agree_whatever_the_partitions(docs):
    key = lambda f: sorted((r["id"], r["taken"]) for r in f.collect())
    assert key(mixing.mixed(docs)) == key(mixing.mixed(docs.repartition(7)))


def test_odd_rows(odd, none):
    check(odd)
    assert mixing.mixed(none).count() == 0


def test_buckets_keep_a_hot_source_near_its_target(spark, monkeypatch):
    frame = spark.createDataFrame([(k, "w " * (1 + k * 7919 % 50), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)], "doc_id long, text string, source string")
    sized = mixing.sizes(frame)
    rows = mixing.repetitions(sized, mixing.targets(mixing.source_totals(sized)), bucket_rows=100).withColumn("taken", F.col("size") * F.col("times")).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.03 * own[0]["target"]


def test_stage_repeats_rows(docs, odd):
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    times = {r["id"]: r["times"] for r in mixing.mixed(docs).collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in times.items() if v}
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_stage_gives_equal_rows_all_their_takings(spark):
    rows = [(None, f"w {k % 3} " * (5 + k % 3), "a", k) for k in range(40)] + [(1, "one two three", "b", k) for k in range(5)] + [(2, "four five six seven", "b", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, own long")
    for weights in ((5.0, 2.0, 1.0), (1.0, 3.0)):
        want = {}
        for r in mixing.mixed(frame, weights=weights).collect():
            want[r["id"], r["source"]] = want.get((r["id"], r["source"]), 0) + r["taken"]
        got, copies = dict.fromkeys(want, 0), {}
        for r in mixing.repeat_documents(frame, weights=weights).collect():
            got[r["doc_id"], r["source"]] += len(r["text"].split())
            copies[r["text"], r["own"]] = copies.get((r["text"], r["own"]), 0) + 1
        assert got == want
        for text in {r[1] for r in rows}:
            n = [copies.get((t, k), 0) for _, t, _, k in rows if t == text]
            assert max(n) - min(n) <= 1


def test_rows_that_repeat_much_spread_over_buckets(spark):
    rows = [(1, "w " * 10, "hot")] * 900 + [(k, "w " * (1 + k % 20), "hot") for k in range(2, 900)]
    sized = mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.repetitions(sized, mixing.targets(mixing.source_totals(sized)), bucket_rows=100).withColumn("taken", F.col("size") * F.col("times")).collect()
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 0.03 * got[0]["target"]
    assert {r["times"] for r in got if r["id"] == 1} == {1, 2}
