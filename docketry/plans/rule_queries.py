"""Operators of the inventory by the rules of its own source: replies, parties, segments, credit, ranks, counts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import replies
from docketry.operators import boosting, classify, geometry, lookup, similarity
from docketry.plans import tables as t
from docketry.plans.queries import BASE, KNN, VECTORS, query
from docketry.session import read

# Stand-ins for authors that are bodies and not parties; one spelling can stand for several.
BODIES = [f"NATION_{k}" for k in range(0, 25, 2)]
BODY_LIST = "[" + ", ".join(f"'{b}'" for b in BODIES) + "]"


@query("names_in_reply", f"WITH {BASE} SELECT paper_id, array_to_string(list_filter(['NATION_3', 'NATION_1', 'nation_7', 'NATION_11'], lambda n: list_contains(parties, upper(n))), ',') AS named FROM lists")
def names_in_reply(spark, sf):
    entry = F.transform("parties", lambda p: F.concat(F.lit(' "'), replies.title_case(p), F.lit("' ")))
    reply = F.concat(F.lit("They are:\n["), F.array_join(entry, ",\n"), F.lit("] and not [NATION_11]"))
    known = F.array(*map(F.lit, ["NATION_3", "NATION_1", "nation_7", "NATION_11"]))
    return t.parties(spark, sf).select("paper_id", F.array_join(replies.names_in_reply(reply, known), ",").alias("named"))


@query("phrases_in_reply", "SELECT conv_id, turn, role || '|' || conv_id || '|]' || turn AS phrases FROM conversations")
def phrases_in_reply(spark, sf):
    reply = F.concat(F.lit('Here: ["'), "role", F.lit('",\n " '), "conv_id", F.lit('\\t", "  ", "]'), "turn", F.lit('"] done'))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(replies.phrases_in_reply(reply), "|").alias("phrases"))


@query("corrected_titles", """SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title,
CASE p_brand WHEN 'Brand#11' THEN 'Brand Eleven' ELSE p_brand END AS maker FROM part""")
def corrected_titles(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", replies.title_case(F.col("p_type")).alias("title"), replies.corrected(F.col("p_brand"), {"Brand#11": "Brand Eleven"}).alias("maker"))


@query("instrument_nouns", "SELECT DISTINCT o_orderstatus AS kind, o_orderstatus || '/X' AS one, o_orderstatus || '/Xs' AS many, 'ATCM instruments' AS whole FROM orders")
def instrument_nouns(spark, sf):
    # Labels are made from the choice of kinds; the kinds are a handful of literals of the table.
    kinds = F.col("o_orderstatus")
    label = lambda plural: F.concat(kinds, F.lit(replies.noun_of(["", "X"], "ATCM instrument", plural)))
    rows = read(spark, sf, "orders").select(kinds.alias("kind"), label(False).alias("one"), label(True).alias("many"), F.lit(replies.noun_of(None, "ATCM instrument", True)).alias("whole"))
    return rows.distinct()


@query("tags_left", f"WITH {BASE} SELECT paper_id, array_to_string(list_filter(parties, lambda p: NOT list_contains(['NATION_1', 'NATION_2', 'NATION_3'], p)), ',') AS rest FROM lists")
def tags_left(spark, sf):
    away = F.array(*(F.lit(f"NATION_{k}") for k in (1, 2, 3)))
    return t.parties(spark, sf).select("paper_id", F.array_join(F.array_except("parties", away), ",").alias("rest"))


@query("rank_one_and_five", KNN + " SELECT left_id, round(max(sim) FILTER (WHERE rank = 1), 6) AS first, round(max(sim) FILTER (WHERE rank = 5), 6) AS fifth FROM k GROUP BY left_id")
def rank_one_and_five(spark, sf):
    near = similarity.nearest(*t.sides(spark, sf), 5)
    at = lambda k: F.round(F.max(F.when(F.col("rank") == k, F.col("sim"))), 6)
    return near.groupBy("left_id").agg(at(1).alias("first"), at(5).alias("fifth"))


@query("exported_and_skipped", "SELECT source, count(*) AS n, count(k) AS exported, count(*) - count(k) AS skipped FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels) ON doc_id = k GROUP BY source")
def exported_and_skipped(spark, sf):
    return lookup.found_and_missing(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id", ["source"])


@query("extreme_rows", f"""WITH {BASE}, r AS (SELECT year, paper_id, row_number() OVER (PARTITION BY year ORDER BY amount DESC, paper_id) AS top, row_number() OVER (PARTITION BY year ORDER BY amount, paper_id) AS low FROM papers)
SELECT year, 'top' AS side, top AS place, paper_id FROM r WHERE top <= 3 UNION ALL SELECT year, 'low', low, paper_id FROM r WHERE low <= 3""")
def extreme_rows(spark, sf):
    return extremes(t.papers(spark, sf).select("year", "paper_id", "amount"), "year", "amount", "paper_id", 3)


def extremes(rows: DataFrame, group: str, value: str, key: str, most: int) -> DataFrame:
    """(group, side, place, key): the rows with the largest and with the smallest value of each group; ties by key. Each task keeps a group's best before they are shuffled."""
    order = F.struct(F.col(value).alias("v"), F.col(key).alias("k"))
    down = F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))

    def best(by, side: str) -> DataFrame:
        ranked = rows.select(group, key, by.alias("_o"))
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_o"))).where(F.col("place") <= most)
        return ranked.select(group, F.lit(side).alias("side"), "place", key)

    return best(down, "top").union(best(order, "low"))


@query("report_order", f"""WITH {BASE}, m AS (SELECT kind, meeting, avg(amount) AS loss FROM papers GROUP BY ALL)
SELECT kind, meeting, row_number() OVER (ORDER BY CASE kind WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, loss, meeting) AS place FROM m""")
def report_order(spark, sf):
    means = t.papers(spark, sf).groupBy("kind", "meeting").agg(F.avg("amount").alias("loss"))
    given = F.when(F.col("kind") == "P", 0).when(F.col("kind") == "F", 1).otherwise(2)
    # A row per kind and meeting: a handful.
    return means.select("kind", "meeting", F.row_number().over(Window.orderBy(given, "loss", "meeting")).alias("place"))


# The vectors of both sides, without their pairs.
PARTIED = f"""WITH {BASE}, {VECTORS[: VECTORS.index(",\npairs AS")]},
real AS (SELECT paper_id, list_filter(parties, lambda p: NOT list_contains({BODY_LIST}, p)) AS parties FROM lists)"""


def _with_real_parties(spark, sf, rows: DataFrame, doc: str) -> DataFrame:
    """``rows`` with ``parties``, those that aren't bodies; null for a paper that nobody authored."""
    # Line items meet the wanted papers before they are gathered.
    wanted = rows.select(F.col(doc).cast("long").alias("paper_id"))
    own = similarity.real_parties(t.parties(spark, sf, wanted), "parties", BODIES).withColumnRenamed("paper_id", doc)
    return rows.join(own, doc, "left")


@query("earliest_match_of_parties", PARTIED + """, m AS (SELECT a.id AS left_id, b.id AS right_id, b.year AS right_year, list_dot_product(a.x, b.x) AS sim FROM a JOIN b ON b.year <= a.year JOIN real ON real.paper_id = b.id WHERE len(real.parties) > 0 AND list_dot_product(a.x, b.x) >= 0.2
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.year, round(sim, 9) DESC, b.id) = 1)
SELECT a.id AS instrument, a.year AS instrument_year, right_id, right_year, round(sim, 6) AS sim FROM a LEFT JOIN m ON m.left_id = a.id""")
def earliest_match_of_parties(spark, sf):
    left, right = t.sides(spark, sf)
    real = _with_real_parties(spark, sf, right, "id").where(F.size("parties") > 0).select("id", "year", "vector")
    out = similarity.earliest_match(left, real, 0.2)
    return out.select("instrument", "instrument_year", "right_id", "right_year", F.round("sim", 6).alias("sim"))


@query("introduction_credit", PARTIED + """, seg AS (SELECT id, id // 3 AS doc, 1961 + (id // 3) % 60 AS year, x FROM v WHERE id % 5 <> 0),
k AS (SELECT a.id AS left_id, a.year, seg.id AS right_id, seg.doc, seg.year AS right_year, list_dot_product(a.x, seg.x) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.x, seg.x), 12) DESC, seg.id) AS rank FROM a, seg QUALIFY rank <= 10),
s AS (SELECT k.*, real.parties FROM k JOIN real ON real.paper_id = k.doc WHERE len(real.parties) > 0 AND right_year <= k.year QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY rank) <= 3),
w AS (SELECT left_id, year, parties, (1 / (1 - sim)) / sum(1 / (1 - sim)) OVER (PARTITION BY left_id) AS weight FROM s),
p AS (SELECT left_id, year, party, round(sum(weight), 10) AS weight FROM (SELECT left_id, year, weight, unnest(parties) AS party FROM w) GROUP BY ALL)
SELECT year, party, round(sum(weight), 6) AS value FROM p GROUP BY ALL""")
def introduction_credit(spark, sf):
    rows = t.vectors(spark, sf).where("id % 5 <> 0").withColumn("doc", F.floor(F.col("id") / 3))
    segments = rows.select("id", (F.lit(1961) + F.col("doc") % 60).alias("year"), "vector")
    near = similarity.nearest(t.sides(spark, sf)[0], segments, 10)
    of = _with_real_parties(spark, sf, rows.select(F.col("id").alias("right_id"), "doc"), "doc")
    credit = similarity.introduction_credit(near.join(of, "right_id"), 3)
    return credit.groupBy("year", "party").agg(F.round(F.sum("weight"), 6).alias("value"))


@query("shift_directions", f"""WITH {VECTORS}, s AS (SELECT p.id AS doc, k.variant, q.x AS shifted, p.x AS base FROM v p CROSS JOIN (VALUES (1), (2), (3)) k(variant) JOIN v q ON q.id = p.id + k.variant WHERE p.id % 4 = 0),
d AS (SELECT doc, variant, unnest(shifted) - unnest(base) AS d, generate_subscripts(base, 1) AS pos FROM s), g AS (SELECT *, d - avg(d) OVER (PARTITION BY doc, pos) AS r FROM d),
m AS (SELECT variant, pos, avg(r) AS m FROM g GROUP BY ALL), u AS (SELECT variant, pos, m / sqrt(sum(m * m) OVER (PARTITION BY variant)) AS m FROM m)
SELECT x.variant AS "left", y.variant AS "right", round(sum(x.m * y.m), 6) AS value FROM u x JOIN u y USING (pos) GROUP BY ALL""")
def shift_directions(spark, sf):
    v = t.vectors(spark, sf)
    base = v.where("id % 4 = 0").select(F.col("id").alias("doc"), F.col("vector").alias("base"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("variant"))
    rows = base.join(v.select("id", F.col("vector").alias("shifted")), F.col("id") == F.col("doc") + F.col("variant"))
    return geometry.direction_cosines(rows, "doc", "variant", "base", "shifted").withColumn("value", F.round("value", 6))


STEMS = """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') WHEN 1 THEN lpad((c_custkey % 200)::VARCHAR, 6, '0') WHEN 2 THEN (c_custkey % 50)::VARCHAR ELSE 'doc_Supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') || '_e' END AS stem FROM customer),
m AS (SELECT stem, list(DISTINCT s_suppkey) AS keys FROM (SELECT DISTINCT stem FROM s) JOIN supplier ON contains(s_name, stem) OR contains(stem, s_name) GROUP BY stem)"""


@query("stem_join_merged", STEMS + " SELECT c_custkey, coalesce(CASE WHEN e.s_suppkey IS NOT NULL THEN e.s_suppkey::VARCHAR END, array_to_string(list_sort(keys), ',')) AS keys FROM s LEFT JOIN supplier e ON e.s_name = s.stem LEFT JOIN m USING (stem)")
def stem_join_merged(spark, sf):
    k, c = (F.col("c_custkey") % 200).cast("string"), F.col("c_custkey") % 4
    name = F.concat(F.lit("Supplier#"), F.lpad(k, 9, "0"))
    stem = F.when(c == 0, name).when(c == 1, F.lpad(k, 6, "0")).when(c == 2, (F.col("c_custkey") % 50).cast("string")).otherwise(F.concat(F.lit("doc_"), name, F.lit("_e")))
    rows = read(spark, sf, "customer").select("c_custkey", stem.alias("stem"))
    # A stem's keys are found, sorted and joined once, not for each of its rows; stems come from remainders, so there are 175 at most.
    found = lookup.by_stem(rows.select("stem").distinct(), read(spark, sf, "supplier"), "stem", "s_name", "s_suppkey", merge=True)
    keys = found.select("stem", F.array_join(F.array_sort("s_suppkey"), ",").alias("keys"))
    return lookup.spread(rows, keys, "stem", "c_custkey").select("c_custkey", "keys")


@query("within_distances", f"""WITH {VECTORS}, d AS (SELECT p.id % 3 AS part, round(1 - list_dot_product(p.x, q.x), 6) AS distance FROM v p JOIN v q ON p.id < q.id)
SELECT part, count(*) AS n, round(avg(distance), 6) AS mean, round(min(distance), 6) AS min, round(max(distance), 6) AS max FROM d GROUP BY part""")
def within_distances(spark, sf):
    found = similarity.own_distances(t.vectors(spark, sf).select("id", (F.col("id") % 3).alias("part"), "vector"), 6)
    return found.select("part", "n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max")))


def _labelled(spark, sf, labels: int) -> DataFrame:
    """Vectors with 0/1 labels of their topics; two vectors make a document."""
    rows = t.vectors(spark, sf)
    return rows.withColumns({"doc": F.floor(F.col("id") / 2), **{f"y{k}": (F.col("topic") % 3 == k).cast("int") for k in range(labels)}})


@query("model_search")
def model_search(spark, sf):
    grid = [{"dims": d, "regParam": r} for d in (2, 4) for r in (0.0, 0.1)]
    found = classify.searched(_labelled(spark, sf, 1), "doc", "vector", ["y0"], "logistic", grid)
    # A row per choice.
    return spark.createDataFrame([(k, c["dims"], c["regParam"], round(loss, 6)) for k, (c, loss) in enumerate(found, 1)], "place int, dims int, penalty double, loss double")


@query("newton_boosting")
def newton_boosting(spark, sf):
    labels = ["y0", "y1", "y2"]
    rows = _labelled(spark, sf, 3).withColumn("part", classify.split("doc")).withColumn("x", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    model = boosting.NewtonBoost(labels, rounds=4, depth=2, share=0.8, bins=16, key="id").fit(rows.where("part <> 'test'"))
    chance = model.probabilities(F.transform("vector", lambda x: x.cast("double")))
    scored = rows.where("part = 'test'").withColumn("p", chance).select(*labels, *(F.get("p", k).alias(f"score_{y}") for k, y in enumerate(labels)))
    return classify.cross_entropy(scored, labels).select("label", "n", F.round("loss", 6).alias("loss"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = _labelled(spark, sf, 2)
    model = classify.fit(rows, "vector", ["y0", "y1"], "svm", 4)
    return classify.permutation_importance(model, rows, "vector", ["y0", "y1"], "id").withColumn("importance", F.round("importance", 6))
