"""One query per operator of the inventory over the driver's tables; the SQL beside each says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import dates, names, text, vectors
from docketry.operators import classify, embedding, evaluation, figures, geometry, graph, lookup, similarity, store, topics
from docketry.plans import tables as t
from docketry.plans.ladder import Figure, by_country, countries_without, ladder, unused_names
from docketry.session import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """authors AS (SELECT DISTINCT l_orderkey AS paper_id, n_name AS party FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
papers AS (SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_orderstatus AS kind, o_orderpriority AS meeting, (o_custkey % 20 - 1)::INT AS topic, o_custkey AS customer, o_totalprice AS amount FROM orders),
wp AS (SELECT * FROM papers WHERE kind = 'F' AND year BETWEEN 1996 AND 2000),
lists AS (SELECT paper_id, list_sort(list(party)) AS parties FROM authors GROUP BY paper_id)"""
VECTORS = """v AS (SELECT vec_id AS id, 1961 + vec_id % 60 AS year, label AS topic, embedding::DOUBLE[] AS x FROM embeddings),
a AS (SELECT * FROM v WHERE id % 5 = 0), b AS (SELECT * FROM v WHERE id % 5 <> 0),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.year AS left_year, b.year AS right_year, list_dot_product(a.x, b.x) AS sim FROM a, b)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _authorship(spark: SparkSession, sf: str) -> DataFrame:
    return figures.yearly_counts(t.authored(spark, sf, t.working_papers(spark, sf).select("paper_id", "year")))


@query("authorship_by_year", f"WITH {BASE} SELECT year, party AS country, count(*) AS value FROM wp JOIN authors USING (paper_id) GROUP BY ALL")
def authorship_by_year(spark, sf):
    return _authorship(spark, sf)


@query("authorship_total", f"WITH {BASE} SELECT party AS country, count(*) AS value FROM wp JOIN authors USING (paper_id) GROUP BY ALL")
def authorship_total(spark, sf):
    return figures.totals(_authorship(spark, sf))


@query("authorship_rollup", f"WITH {BASE} SELECT party AS country, year, count(*) AS value FROM wp JOIN authors USING (paper_id) GROUP BY ROLLUP (party, year)")
def authorship_rollup(spark, sf):
    return _authorship(spark, sf).rollup("country", "year").agg(F.sum("value").alias("value"))


@query("dedupe_keep_first", "SELECT user_id, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_keep_first(spark, sf):
    late = read(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-03").cast("timestamp")).select("user_id", "event_id", "event_type", "ts")
    return figures.first_rows(late, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("party_split_normalise", """WITH p AS (SELECT c_custkey, unnest(list_transform(string_split(c_mktsegment || ' | ' || n_name || '|', '|'), lambda x: lower(trim(x)))) AS raw, generate_subscripts(string_split(c_mktsegment || ' | ' || n_name || '|', '|'), 1) - 1 AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, pos::INT AS pos, coalesce(lower(r_name), raw) AS party FROM p LEFT JOIN (SELECT lower(n_name) AS alias, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON raw = alias""")
def party_split_normalise(spark, sf):
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = rows.select("c_custkey", F.posexplode(names.split_parties(F.array(F.concat("c_mktsegment", F.lit(" | "), "n_name", F.lit("|"))))).alias("pos", "party"))
    aliases = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("country"))
    return names.canonical(parts, aliases, "party")


LADDER = f"""WITH {BASE}, bridge AS (SELECT r_name AS country, lower(n_name) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 24 UNION SELECT r_name, lower(r_name) FROM region),
spine AS (SELECT r_name AS country FROM region UNION ALL SELECT 'ATLANTIS'),
f AS (SELECT 'Papers' AS figure, lower(party) AS alias, count(*)::DOUBLE AS value FROM wp JOIN authors USING (paper_id) GROUP BY ALL
      UNION ALL SELECT 'Balance', lower(n_name), avg(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT country, figure, sum(value) AS value FROM f JOIN bridge USING (alias) GROUP BY ALL),
cells AS (SELECT spine.country, g.figure, coalesce(s.value, g.missing) AS value FROM spine CROSS JOIN (VALUES ('Papers', 0.0::DOUBLE), ('Balance', NULL)) g(figure, missing) LEFT JOIN s ON s.country = spine.country AND s.figure = g.figure)"""


def _figures(spark: SparkSession, sf: str) -> list[Figure]:
    balance = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.avg("c_acctbal").alias("value"))
    return [Figure("Papers", figures.totals(_authorship(spark, sf))), Figure("Balance", balance, None)]


@query("alias_rollup_ladder", LADDER + " SELECT country, figure, round(value, 6) AS value FROM cells")
def alias_rollup_ladder(spark, sf):
    return by_country(_figures(spark, sf), *t.regions(spark, sf)).withColumn("value", F.round("value", 6))


@query("ladder_pivot", LADDER + ' SELECT country, max(value) FILTER (WHERE figure = \'Papers\') AS papers, round(max(value) FILTER (WHERE figure = \'Balance\'), 6) AS balance FROM cells GROUP BY country')
def ladder_pivot(spark, sf):
    return ladder(_figures(spark, sf), *t.regions(spark, sf)).select("country", F.col("Papers").alias("papers"), F.round("Balance", 6).alias("balance"))


@query("coverage_unused_keys", LADDER + " SELECT DISTINCT alias FROM f WHERE figure = 'Papers' AND alias NOT IN (SELECT alias FROM bridge)")
def coverage_unused_keys(spark, sf):
    return unused_names(figures.totals(_authorship(spark, sf)), *t.regions(spark, sf))


@query("coverage_missing", LADDER + " SELECT country FROM spine WHERE country NOT IN (SELECT country FROM bridge JOIN f USING (alias) WHERE figure = 'Papers')")
def coverage_missing(spark, sf):
    return countries_without(figures.totals(_authorship(spark, sf)), *t.regions(spark, sf))


@query("weighted_operator_sum", f"""WITH {BASE}, s AS (SELECT paper_id, max(party) AS second FROM authors GROUP BY paper_id),
r AS (SELECT n_name AS first, CASE WHEN paper_id % 7 = 0 THEN NULL WHEN paper_id % 11 = 0 THEN 'nan' ELSE second END AS second, amount * CASE meeting WHEN '5-LOW' THEN 0.25 ELSE 1.0 END AS value FROM papers JOIN s USING (paper_id) JOIN customer ON customer = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT first AS country, CASE WHEN second IS NULL OR second = 'nan' THEN value ELSE value * 0.75 END AS value FROM r UNION ALL SELECT second, value * 0.25 FROM r WHERE second <> 'nan')
SELECT country, round(sum(value::DECIMAL(38,8))::DOUBLE, 4) AS value FROM e GROUP BY country""")
def weighted_operator_sum(spark, sf):
    second = t.authored(spark, sf, t.papers(spark, sf).select("paper_id")).groupBy("paper_id").agg(F.max("party").alias("party"))
    first = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("first"))
    rows = t.papers(spark, sf).join(second, "paper_id").join(first, F.col("customer") == F.col("c_custkey"))
    rows = rows.withColumn("second", F.when(F.col("paper_id") % 7 == 0, None).when(F.col("paper_id") % 11 == 0, "nan").otherwise(F.col("party")))
    out = figures.split_weights(rows, "first", "second", "amount", F.when(F.col("meeting") == "5-LOW", 0.25).otherwise(1.0))
    return out.withColumn("value", F.round("value", 4))


@query("leadership_cell_counts", """WITH g AS (SELECT (1990 + p_size % 20)::INT AS year, unnest([replace(p_name, ' ', ' & '), p_brand || ' &' || p_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END]) AS cell FROM part),
n AS (SELECT year, trim(unnest(string_split(cell, '&'))) AS country FROM g WHERE trim(cell) <> '') SELECT year, country, count(*) AS value FROM n WHERE country <> '' GROUP BY ALL""")
def leadership_cell_counts(spark, sf):
    p = read(spark, sf, "part")
    grid = p.select((F.lit(1990) + F.col("p_size") % 20).alias("year"), F.replace("p_name", F.lit(" "), F.lit(" & ")).alias("a"), F.concat("p_brand", F.lit(" &"), "p_type").alias("b"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("c"))
    return figures.cell_counts(grid, "year", ["a", "b", "c"])


# The stand-in dictionary of affiliations. Two keys of one length that name different countries make a string ambiguous.
HOSTS = [("example.com", "chile"), ("example.net", "france"), ("blog.", "norway"), ("/de/", "germany"), ("/fr/", "france"), ("example", "peru")]


@query("affiliation_longest_match", """WITH p AS (SELECT lower(url) AS u FROM pages),
m AS (SELECT CASE WHEN contains(u, 'example.com') AND contains(u, 'example.net') THEN NULL WHEN contains(u, 'example.com') THEN 'chile' WHEN contains(u, 'example.net') THEN 'france' WHEN contains(u, 'example') THEN 'peru'
  WHEN contains(u, 'blog.') THEN 'norway' WHEN contains(u, '/de/') AND contains(u, '/fr/') THEN NULL WHEN contains(u, '/de/') THEN 'germany' WHEN contains(u, '/fr/') THEN 'france' END AS country FROM p)
SELECT country, count(*) AS value FROM m WHERE country IS NOT NULL GROUP BY country""")
def affiliation_longest_match(spark, sf):
    found = figures.longest_key(read(spark, sf, "pages").select("page_id", "url"), "url", HOSTS)
    return found.where("country is not null").groupBy("country").agg(F.count("*").alias("value"))


@query("mention_dense_grid", f"""WITH {BASE}, c AS (SELECT year, party AS country, count(*) AS value FROM papers JOIN authors USING (paper_id) WHERE kind = 'P' AND meeting = '1-URGENT' GROUP BY ALL)
SELECT y.year::INT AS year, n_name AS country, coalesce(value, 0) AS value FROM nation CROSS JOIN (SELECT unnest(range(1994, 2004)) AS year) y LEFT JOIN c ON c.year = y.year AND c.country = n_name""")
def mention_dense_grid(spark, sf):
    some = t.authored(spark, sf, t.papers(spark, sf).where("kind = 'P' and meeting = '1-URGENT'").select("paper_id", "year"))
    return figures.dense_grid(figures.yearly_counts(some), (1994, 2003), read(spark, sf, "nation").select(F.col("n_name").alias("country")))


APPROVALS = """WITH li AS (SELECT l_orderkey, n_name, n_nationkey, min(l_shipdate) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
pairs AS (SELECT l_orderkey AS paper_id, year(o_orderdate)::INT AS adopted, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' *' ELSE '' END AS country, CASE WHEN n_nationkey % 4 <> 0 THEN year(d)::INT END AS year FROM li JOIN orders ON l_orderkey = o_orderkey),
delays AS (SELECT paper_id, adopted, left(country, length(country) - 2) AS country, coalesce(year, 2025) - adopted AS delay FROM pairs WHERE country LIKE '%*')"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return figures.approval_pairs(t.approvals(spark, sf), "paper_id", "approvals", keep=["adopted"])


@query("approval_pairs", APPROVALS + " SELECT paper_id, country, year FROM pairs")
def approval_pairs(spark, sf):
    return figures.approval_pairs(t.approvals(spark, sf), "paper_id", "approvals")


@query("ratification_delay_mean", APPROVALS + " SELECT country, round(avg(delay), 6) AS value FROM delays GROUP BY country")
def ratification_delay_mean(spark, sf):
    return figures.approval_delays(_pairs(spark, sf)).groupBy("country").agg(F.round(F.avg("delay"), 6).alias("value"))


@query("ratification_delay_by_year", APPROVALS + " SELECT adopted AS year, country, round(avg(delay), 6) AS value FROM delays GROUP BY ALL")
def ratification_delay_by_year(spark, sf):
    return figures.approval_delays(_pairs(spark, sf)).groupBy(F.col("adopted").alias("year"), "country").agg(F.round(F.avg("delay"), 6).alias("value"))


ROMAN = "['','X','XX','XXX','XL','L'][(k // 10)::INT + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][(k % 10)::INT + 1]"
MEETINGS = "[" + ", ".join(map(str, dates.MEETING_YEARS)) + "]"


@query("meeting_number_to_year", f"""WITH n AS (SELECT p_partkey, p_partkey % 55 + 1 AS k, p_partkey % 5 AS c FROM part)
SELECT p_partkey, (CASE WHEN c < 3 THEN CASE WHEN k <= 44 THEN {MEETINGS}[k::INT] ELSE 2022 + k - 44 END WHEN c = 3 THEN 1960 + k END)::INT AS year FROM n""")
def meeting_number_to_year(spark, sf):
    k = F.col("p_partkey") % 55 + 1
    roman = F.concat(F.get(F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L"])), F.floor(k / 10).cast("int")), F.get(F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), (k % 10).cast("int")))
    c = F.col("p_partkey") % 5
    name = F.when(c == 0, F.concat(F.lit("ATCM "), roman)).when(c == 1, F.concat(F.lit("Report of ATCM"), k.cast("string"))).when(c == 2, F.concat(F.lit("ATCM "), roman, F.lit(" - CEP"))).when(c == 3, F.concat(F.lit("SATCM XI (Town, "), (F.lit(1960) + k).cast("string"), F.lit(")"))).otherwise("ATCM Information Paper")
    return read(spark, sf, "part").select("p_partkey", dates.year_of_meeting_name(name).alias("year"))


@query("title_enrichment", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Measure' WHEN 1 THEN 'Decision' WHEN 2 THEN 'Resolution' WHEN 3 THEN 'Recommendation' END AS type,
CASE p_partkey % 4 WHEN 0 THEN 'CCAS' WHEN 1 THEN 'SATCM' WHEN 2 THEN 'ATCM' ELSE 'Unknown' END AS meeting, CASE WHEN p_size <= 28 THEN 2000 + p_size END::INT AS adopted, CASE p_partkey % 3 WHEN 0 THEN 2025 WHEN 1 THEN 1990 + p_size ELSE 1950 + p_size END::INT AS ended FROM part""")
def title_enrichment(spark, sf):
    p = read(spark, sf, "part")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (F.col("p_partkey") % n).cast("int"))
    size = F.col("p_size")
    status = F.when(F.col("p_partkey") % 3 == 0, "Not yet effective").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Effective 01/02/1970. No longer current:D 1 ("), (size + 1990).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Effective 11/05/"), (size + 1950).cast("string")))
    dated = F.concat(F.lit("Effective "), F.format_string("%02d/02/%d", size, size + 2000))
    return p.select("p_partkey", dates.instrument_type(F.concat(pick(5, "Measure", "Decision", "Resolution", "Recommendation", "Minutes"), F.lit(" 5 (2001)"))).alias("type"), dates.meeting_type(F.concat(pick(4, "CCAS (Bonn)", "SATCM IV", "CEP II", "Workshop"), F.lit(" - Town"))).alias("meeting"), dates.adoption_year(dated, two_digits=True).alias("adopted"), dates.end_year(status).alias("ended"))


EDGES = f"""WITH {BASE}, e AS (SELECT a.paper_id, wp.year, least(a.party, b.party) AS source, greatest(a.party, b.party) AS target FROM authors a JOIN authors b ON a.paper_id = b.paper_id AND a.party < b.party JOIN wp ON wp.paper_id = a.paper_id)"""


@query("coauthor_edges", EDGES + " SELECT source, target, count(*) AS weight FROM e GROUP BY ALL")
def coauthor_edges(spark, sf):
    return graph.coauthor_edges(t.with_parties(spark, sf, t.working_papers(spark, sf).select("paper_id")))


@query("coauthor_edges_by_period", EDGES + " SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS period, source, target, count(*) AS weight FROM e GROUP BY ALL")
def coauthor_edges_by_period(spark, sf):
    rows = figures.in_periods(t.with_parties(spark, sf, t.working_papers(spark, sf).select("paper_id", "year")), "year", [("early", 1990, 1997), ("late", 1998, 2010)])
    return graph.coauthor_edges(rows, by=["period"])


@query("edge_weight_normalised", EDGES + ", w AS (SELECT source, target, count(*) AS weight FROM e GROUP BY ALL) SELECT source, target, round(weight / (SELECT max(weight) FROM w), 9) AS weight FROM w")
def edge_weight_normalised(spark, sf):
    return graph.normalised(coauthor_edges(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("collaboration_diversity", f"WITH {BASE} SELECT a.party AS country, count(DISTINCT b.party) AS value FROM authors a JOIN authors b ON a.paper_id = b.paper_id AND a.party <> b.party JOIN wp ON wp.paper_id = a.paper_id GROUP BY ALL")
def collaboration_diversity(spark, sf):
    return graph.collaborators(t.with_parties(spark, sf, t.working_papers(spark, sf).select("paper_id")))


@query("katz_centrality")
def katz_centrality(spark, sf):
    return graph.katz(coauthor_edges_by_period(spark, sf))


@query("topic_diversity_by_period", f"WITH {BASE}, d AS (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS period, party AS country, topic FROM wp JOIN authors USING (paper_id) WHERE topic <> -1) SELECT period, country, count(DISTINCT topic) AS value FROM d GROUP BY ALL")
def topic_diversity_by_period(spark, sf):
    rows = t.authored(spark, sf, t.working_papers(spark, sf).select("paper_id", "year", "topic")).withColumnRenamed("party", "country")
    return figures.distinct_topics(figures.in_periods(rows, "year", [("early", 1990, 1997), ("late", 1998, 2010)]), ["period", "country"])


@query("topic_introduction", f"WITH {BASE}, f AS (SELECT * FROM papers WHERE topic <> -1 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY year || '_' || paper_id, paper_id) = 1) SELECT year, party AS country, count(*) AS value FROM f JOIN authors USING (paper_id) GROUP BY ALL")
def topic_introduction(spark, sf):
    docs = t.papers(spark, sf).withColumn("sort_string", F.concat_ws("_", "year", "paper_id"))
    first = figures.earliest_per_topic(docs).select("paper_id", "year")
    return figures.yearly_counts(t.authored(spark, sf, first))


KNN = f"WITH {VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(sim, 12) DESC, right_id) AS rank FROM pairs QUALIFY rank <= 10)"


@query("knn_join_k10", KNN + " SELECT left_id, rank::INT AS rank, right_id, round(sim, 6) AS sim FROM k")
def knn_join_k10(spark, sf):
    return similarity.nearest(*t.sides(spark, sf), 10).select("left_id", "rank", "right_id", F.round("sim", 6).alias("sim"))


@query("inverse_distance_credit", KNN + """, s AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY rank) AS n FROM k WHERE right_year <= left_year QUALIFY n <= 3), w AS (SELECT right_id % 7 AS party, left_year AS year, (1 / (1 - sim)) / sum(1 / (1 - sim)) OVER (PARTITION BY left_id) AS weight FROM s)
SELECT year, party, round(sum(weight), 6) AS value FROM w GROUP BY ALL""")
def inverse_distance_credit(spark, sf):
    survivors = similarity.nearest(*t.sides(spark, sf), 10).where("right_year <= left_year")
    credit = similarity.inverse_distance_credit(survivors)
    return credit.groupBy(F.col("left_year").alias("year"), (F.col("right_id") % 7).alias("party")).agg(F.round(F.sum("weight"), 6).alias("value"))


MATCH = f"""WITH {VECTORS}, m AS (SELECT left_id, right_id, right_year, sim FROM pairs WHERE sim >= 0.2 AND right_year <= left_year QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY right_year, round(sim, 9) DESC, right_id) = 1),
h AS (SELECT a.id, a.year - min(b.year) AS available FROM a LEFT JOIN b ON b.year <= a.year GROUP BY a.id, a.year),
r AS (SELECT a.id AS instrument, a.year AS instrument_year, a.topic, right_id, right_year, sim, a.year - right_year AS lag, h.available FROM a LEFT JOIN m ON m.left_id = a.id JOIN h ON h.id = a.id)"""


def _matches(spark: SparkSession, sf: str, threshold: float = 0.2) -> DataFrame:
    left, right = t.sides(spark, sf)
    out = similarity.earliest_match(left, right, threshold).join(similarity.available_history(left, right), "instrument")
    return out.join(t.instruments(spark, sf).select(F.col("id").alias("instrument"), "topic"), "instrument").withColumn("lag", F.col("instrument_year") - F.col("right_year"))


@query("earliest_match", MATCH + " SELECT instrument, instrument_year, right_id, right_year, round(sim, 6) AS sim, available FROM r")
def earliest_match(spark, sf):
    return _matches(spark, sf).select("instrument", "instrument_year", "right_id", "right_year", F.round("sim", 6).alias("sim"), "available")


@query("match_latency_by_topic", MATCH + """ SELECT topic, count(*) AS n_total, count(*) FILTER (WHERE right_id IS NULL) AS n_unmatched, round(avg((right_id IS NOT NULL)::INT), 6) AS coverage, round(avg(lag), 6) AS mean_lag, round(stddev_pop(lag), 6) AS std_lag, min(lag) AS min_lag,
quantile_cont(lag, 0.25) AS q1, quantile_cont(lag, 0.5) AS median_lag, quantile_cont(lag, 0.75) AS q3, max(lag) AS max_lag, quantile_cont(available, 0.5) FILTER (WHERE right_id IS NOT NULL) AS ceiling, round(avg((lag = available)::INT), 6) AS at_ceiling, round(avg(sim), 6) AS mean_sim FROM r WHERE topic <> 9 GROUP BY topic""")
def match_latency_by_topic(spark, sf):
    m = _matches(spark, sf).where("topic <> 9")
    q = lambda c, p: F.percentile(c, F.lit(p))
    hit = F.col("right_id").isNotNull()
    return m.groupBy("topic").agg(F.count("*").alias("n_total"), F.count_if(~hit).alias("n_unmatched"), F.round(F.avg(hit.cast("int")), 6).alias("coverage"), F.round(F.avg("lag"), 6).alias("mean_lag"), F.round(F.stddev_pop("lag"), 6).alias("std_lag"), F.min("lag").alias("min_lag"), q("lag", 0.25).alias("q1"), q("lag", 0.5).alias("median_lag"), q("lag", 0.75).alias("q3"), F.max("lag").alias("max_lag"), q(F.when(hit, F.col("available")), 0.5).alias("ceiling"), F.round(F.avg((F.col("lag") == F.col("available")).cast("int")), 6).alias("at_ceiling"), F.round(F.avg("sim"), 6).alias("mean_sim"))


@query("chance_latency", f"WITH {VECTORS}, i AS (SELECT a.topic, a.id, quantile_cont(a.year - b.year, 0.5) AS m FROM a JOIN b ON b.year <= a.year WHERE a.topic <> 9 GROUP BY ALL) SELECT topic, quantile_cont(m, 0.5) AS chance FROM i GROUP BY topic")
def chance_latency(spark, sf):
    topical = t.instruments(spark, sf).withColumn("topic", F.when(F.col("topic") == 9, -1).otherwise(F.col("topic")))
    return similarity.chance_latency(topical, t.prior_papers(spark, sf))


SWEEP = [0.15, 0.2, 0.25]


@query("threshold_sweep", f"""WITH {VECTORS}, e AS (SELECT t.threshold, pairs.* FROM pairs JOIN (SELECT unnest([0.15, 0.2, 0.25]::DOUBLE[]) AS threshold) t ON sim >= threshold WHERE right_year <= left_year),
h AS (SELECT a.id AS left_id, a.year - min(b.year) AS available FROM a JOIN b ON b.year <= a.year GROUP BY a.id, a.year),
p AS (SELECT threshold, left_id, min(left_year) - min(right_year) AS earliest, count(*) AS n FROM e GROUP BY ALL),
q AS (SELECT threshold, left_id, left_year - right_year AS nearest FROM e QUALIFY row_number() OVER (PARTITION BY threshold, left_id ORDER BY round(sim, 9) DESC, right_id) = 1)
SELECT threshold, count(*) AS n_covered, quantile_cont(earliest, 0.5) AS median_lag_earliest, round(avg(earliest), 6) AS mean_lag_earliest, quantile_cont(nearest, 0.5) AS median_lag_nearest, quantile_cont(available, 0.5) AS median_available_history, round(quantile_cont(earliest / nullif(available, 0), 0.5), 6) AS degeneracy_ratio, quantile_cont(n, 0.5) AS median_candidates, round(count(*) / (SELECT count(*) FROM a), 6) AS coverage FROM p JOIN q USING (threshold, left_id) JOIN h USING (left_id) GROUP BY threshold""")
def threshold_sweep(spark, sf):
    left, right = t.sides(spark, sf)
    out = similarity.threshold_sweep(left, right, SWEEP)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_lag_earliest", "degeneracy_ratio", "coverage")})


@query("decade_lag_family", f"""WITH {VECTORS}, e AS (SELECT t.threshold, left_id, any_value(left_year) AS left_year, any_value(left_year) - min(right_year) AS lag FROM pairs JOIN (SELECT unnest([0.15, 0.2, 0.25]::DOUBLE[]) AS threshold) t ON sim >= threshold WHERE right_year <= left_year GROUP BY ALL)
SELECT (left_year // 10 * 10)::INT AS decade, quantile_cont(lag, 0.5) FILTER (WHERE threshold = 0.15) AS lag_015, quantile_cont(lag, 0.5) FILTER (WHERE threshold = 0.2) AS lag_020, quantile_cont(lag, 0.5) FILTER (WHERE threshold = 0.25) AS lag_025 FROM e GROUP BY 1""")
def decade_lag_family(spark, sf):
    found = similarity.matches_by_threshold(*t.sides(spark, sf), SWEEP)
    each = found.select("threshold", F.col("left_year").alias("y"), (F.col("left_year") - F.col("first.year")).alias("lag"))
    wide = each.groupBy(dates.decade(F.col("y")).alias("decade")).pivot("threshold", SWEEP).agg(F.percentile("lag", F.lit(0.5)))
    return wide.toDF("decade", "lag_015", "lag_020", "lag_025")


@query("policy_edges_backward", f"WITH {VECTORS} SELECT left_id, right_id, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.2 AND right_year <= left_year")
def policy_edges_backward(spark, sf):
    return similarity.pairs_above(*t.sides(spark, sf), 0.2, backward=True).select("left_id", "right_id", F.round("sim", 6).alias("sim"))


@query("policy_edges_unrestricted", f"WITH {VECTORS} SELECT left_id, right_id, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.2")
def policy_edges_unrestricted(spark, sf):
    return similarity.pairs_above(*t.sides(spark, sf), 0.2).select("left_id", "right_id", F.round("sim", 6).alias("sim"))


@query("policy_closest", f"WITH {VECTORS} SELECT left_id, right_id, round(sim, 6) AS sim FROM pairs QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(sim, 12) DESC, right_id) = 1")
def policy_closest(spark, sf):
    return similarity.nearest(*t.sides(spark, sf), 1).select("left_id", "right_id", F.round("sim", 6).alias("sim"))


@query("policy_summary", f"WITH {VECTORS} SELECT count(*) AS edges, count(DISTINCT left_id) AS instruments, count(DISTINCT right_id) AS papers, count(*) FILTER (WHERE right_year > left_year) AS postdating, round(avg((right_year > left_year)::INT), 6) AS share FROM pairs WHERE sim >= 0.2")
def policy_summary(spark, sf):
    late = F.col("right_year") > F.col("left_year")
    return similarity.pairs_above(*t.sides(spark, sf), 0.2).agg(F.count("*").alias("edges"), F.count_distinct("left_id").alias("instruments"), F.count_distinct("right_id").alias("papers"), F.count_if(late).alias("postdating"), F.coalesce(F.round(F.avg(late.cast("int")), 6), F.lit(0.0)).alias("share"))


@query("match_rate_by_decade", MATCH + " SELECT (instrument_year // 10 * 10)::INT AS decade, count(right_id) AS matched, count(*) AS total, quantile_cont(lag, 0.5) AS median_lag FROM r GROUP BY 1 HAVING count(*) >= 3")
def match_rate_by_decade(spark, sf):
    return _matches(spark, sf).groupBy(dates.decade(F.col("instrument_year")).alias("decade")).agg(F.count("right_id").alias("matched"), F.count("*").alias("total"), F.percentile("lag", F.lit(0.5)).alias("median_lag")).where("total >= 3")


@query("decade_type_pivot", f"WITH {BASE} SELECT (year // 10 * 10)::INT AS decade, count(*) FILTER (WHERE kind = 'F') AS f, count(*) FILTER (WHERE kind = 'O') AS o, count(*) FILTER (WHERE kind = 'P') AS p FROM papers GROUP BY 1")
def decade_type_pivot(spark, sf):
    return t.papers(spark, sf).groupBy(dates.decade(F.col("year")).alias("decade")).pivot("kind", ["F", "O", "P"]).count().na.fill(0).toDF("decade", "f", "o", "p")


BANDS = f"""WITH {VECTORS}, c AS (SELECT coalesce(x.year, y.year) AS year, least(40, greatest(1, coalesce(x.n, 0), coalesce(y.n, 0))) AS units FROM (SELECT year, count(*) AS n FROM a GROUP BY year) x FULL JOIN (SELECT year, count(*) AS n FROM b GROUP BY year) y ON x.year = y.year),
g AS (SELECT year, units, sum(units) OVER (ORDER BY year) AS upto, sum(units) OVER () AS total FROM c), bands AS (SELECT year, units, 1 - (upto - units) / total AS top, 1 - upto / total AS bottom FROM g)"""


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    left, right = t.sides(spark, sf)
    a, b = (x.groupBy("year").agg(F.count("*").alias(n)) for x, n in ((left, "na"), (right, "nb")))
    units = a.join(b, "year", "full").select("year", F.least(F.lit(40), F.greatest(F.lit(1), F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("units"))
    # One row per calendar year, so a window over all of them is small.
    upto, total = F.sum("units").over(Window.orderBy("year")), F.sum("units").over(Window.partitionBy())
    return units.select("year", "units", (1 - (upto - F.col("units")) / total).alias("top"), (1 - upto / total).alias("bottom"))


@query("year_bands", BANDS + " SELECT year, units::BIGINT AS units, round(top, 9) AS top, round(bottom, 9) AS bottom FROM bands")
def year_bands(spark, sf):
    return _bands(spark, sf).select("year", F.col("units").cast("long"), F.round("top", 9).alias("top"), F.round("bottom", 9).alias("bottom"))


@query("node_positions", BANDS + """, n AS (SELECT a.id, a.year, row_number() OVER (PARTITION BY a.year ORDER BY a.id) - 1 AS k, count(*) OVER (PARTITION BY a.year) AS n FROM a)
SELECT id, round(CASE WHEN n = 1 THEN (top + bottom) / 2 ELSE top - (top - bottom) * 0.12 - k * (top - bottom) * 0.76 / (n - 1) END, 9) AS y FROM n JOIN bands USING (year)""")
def node_positions(spark, sf):
    by = Window.partitionBy("year")
    nodes = t.sides(spark, sf)[0].select("id", "year", (F.row_number().over(by.orderBy("id")) - 1).alias("k"), F.count("*").over(by).alias("n"))
    height = F.col("top") - F.col("bottom")
    y = F.when(F.col("n") == 1, (F.col("top") + F.col("bottom")) / 2).otherwise(F.col("top") - height * 0.12 - F.col("k") * height * 0.76 / F.nullif(F.col("n") - 1, F.lit(0)))
    return nodes.join(_bands(spark, sf), "year").select("id", F.round(y, 9).alias("y"))


COMPOSITION = f"""WITH {VECTORS}, c AS (SELECT topic, count(*) AS size, count(*) FILTER (WHERE id % 5 = 0) AS n_instruments, count(*) FILTER (WHERE id % 5 <> 0) AS n_papers, avg((id % 5 = 0)::INT) AS instrument_share, min(year) AS first_year, max(year) AS last_year, min(year) FILTER (WHERE id % 5 = 0) AS first_instrument_year, min(year) FILTER (WHERE id % 5 <> 0) AS first_paper_year FROM v GROUP BY topic)"""


@query("topic_composition", COMPOSITION + " SELECT * REPLACE (round(instrument_share, 6) AS instrument_share) FROM c")
def topic_composition(spark, sf):
    return topics.composition(t.vectors(spark, sf).withColumn("is_instrument", F.col("id") % 5 == 0)).withColumn("instrument_share", F.round("instrument_share", 6))


@query("composition_buckets", COMPOSITION + " SELECT CASE WHEN n_instruments = 0 THEN 'papers only' WHEN n_papers = 0 THEN 'instruments only' WHEN instrument_share < 0.25 THEN 'mostly papers' WHEN instrument_share <= 0.75 THEN 'mixed' ELSE 'mostly instruments' END AS bucket, count(*) AS topics, sum(size)::BIGINT AS documents FROM c GROUP BY 1")
def composition_buckets(spark, sf):
    return topics.composition_buckets(topics.composition(t.vectors(spark, sf).withColumn("is_instrument", F.col("id") % 5 == 0)))


@query("geometry_summary", f"WITH {VECTORS}, d AS (SELECT left_id % 3 AS part, round(1 - sim, 6) AS d FROM pairs) SELECT part, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, min(d) AS min, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, max(d) AS max FROM d GROUP BY part")
def geometry_summary(spark, sf):
    left, right = t.sides(spark, sf)
    d = similarity.distance_counts(left.withColumn("part", F.col("id") % 3), right, 6)
    return geometry.counted_summary(d, "distance", "n", ["part"]).select("part", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p05", "p50", "p95", "max")))


@query("similarity_histogram", f"WITH {VECTORS}, h AS (SELECT least(floor(round(1 - sim, 6) / (2.0::DOUBLE / 60)), 59)::INT AS bin FROM pairs) SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM h) * (2.0::DOUBLE / 60)), 6) AS density FROM h GROUP BY bin")
def similarity_histogram(spark, sf):
    left, right = t.sides(spark, sf)
    d = similarity.distance_counts(left.withColumn("part", F.lit(0).cast("long")), right, 6)
    # Copies of vectors a little longer than 1 are a rounding below 0.
    d = d.withColumn("distance", F.greatest(F.lit(0.0), "distance"))
    return geometry.histogram(d, "distance", 0.0, 2.0, 60, "n").withColumn("density", F.round("density", 6))


@query("mean_pool_segments", f"""WITH {VECTORS}, p AS (SELECT id // 4 AS doc, pos, avg(val) AS m, count(*) AS n FROM (SELECT id, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM v) GROUP BY ALL)
SELECT doc, max(n) AS n, round(max(m) FILTER (WHERE pos = 1) / sqrt(sum(m * m)), 6) AS first, round(sum(m) / sqrt(sum(m * m)), 6) AS total FROM p GROUP BY doc""")
def mean_pool_segments(spark, sf):
    pooled = geometry.mean_pool(t.vectors(spark, sf).withColumn("doc", F.floor(F.col("id") / 4)), "doc", "vector")
    return pooled.select("doc", "n", F.round(F.get("pooled", 0), 6).alias("first"), F.round(F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("mean_pairwise_cosine", f"WITH {VECTORS} SELECT p.topic, (SELECT count(*) FROM v WHERE v.topic = p.topic) AS n, round(avg(list_cosine_similarity(p.x, q.x)), 6) AS value FROM v p JOIN v q ON p.topic = q.topic AND p.id < q.id GROUP BY p.topic")
def mean_pairwise_cosine(spark, sf):
    return geometry.mean_pairwise_cosine(t.vectors(spark, sf), "topic", "vector").withColumn("value", F.round("value", 6))


@query("subspace_projection")
def subspace_projection(spark, sf):
    v = t.vectors(spark, sf)
    away = geometry.SubspaceProjection(list(geometry.mean_directions(v.where("topic < 5"), "topic", "vector").values()))
    out = v.withColumn("left", away.column(F.col("vector")))
    return out.select("id", F.round(vectors.dot(F.col("left"), F.col("left")), 6).alias("length"), F.round(vectors.dot(F.col("left"), F.col("vector")), 6).alias("kept"))


@query("shift_decomposition", f"""WITH {VECTORS}, s AS (SELECT p.id AS doc, k.variant, q.x AS shifted, p.x AS base FROM v p CROSS JOIN (VALUES (1), (2), (3)) k(variant) JOIN v q ON q.id = p.id + k.variant WHERE p.id % 4 = 0),
d AS (SELECT doc, variant, unnest(shifted) - unnest(base) AS d, generate_subscripts(base, 1) AS pos FROM s), g AS (SELECT *, d - avg(d) OVER (PARTITION BY doc, pos) AS r FROM d),
l AS (SELECT doc, variant, sqrt(sum(r * r)) AS own, sqrt(sum(d * d)) AS move FROM g GROUP BY ALL),
c AS (SELECT doc, variant, 1 - list_dot_product(base, shifted) / sqrt(list_dot_product(base, base) * list_dot_product(shifted, shifted)) AS cosine FROM s),
u AS (SELECT g.variant, pos, sum(r / own) AS s FROM g JOIN l USING (doc, variant) WHERE own > 0 GROUP BY ALL), q AS (SELECT variant, sum(s * s) AS q FROM u GROUP BY variant)
SELECT variant, count(*) AS n, round(avg(cosine), 6) AS shift, round(avg(own / move), 6) AS fraction, round((any_value(q) - count(*)) / (count(*) * (count(*) - 1)), 6) AS consistency FROM l JOIN c USING (doc, variant) JOIN q USING (variant) GROUP BY variant""")
def shift_decomposition(spark, sf):
    v = t.vectors(spark, sf)
    base = v.where("id % 4 = 0").select(F.col("id").alias("doc"), F.col("vector").alias("base"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("variant"))
    rows = base.join(v.select("id", F.col("vector").alias("shifted")), F.col("id") == F.col("doc") + F.col("variant"))
    return geometry.shift_decomposition(rows, "doc", "variant", "base", "shifted").select("variant", "n", *(F.round(c, 6).alias(c) for c in ("shift", "fraction", "consistency")))


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC) = 1")
def latest_per_key(spark, sf):
    hours = read(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return store.latest(hours, ["user_id"], "hour").select("user_id", "event_id", "event_type")


@query("paged_text_concat", """WITH p AS (SELECT conv_id, turn * 2 + turn % 3 AS turn, text FROM conversations), l AS (SELECT conv_id, unnest(range(0, max(turn) + 1)) AS turn FROM p GROUP BY conv_id)
SELECT conv_id, count(*) AS n_pages, sha256(string_agg(coalesce(p.text, '') || chr(10), '' ORDER BY l.turn)) AS text_sha FROM l LEFT JOIN (SELECT conv_id, turn, max(text) AS text FROM p GROUP BY ALL) p USING (conv_id, turn) GROUP BY conv_id""")
def paged_text_concat(spark, sf):
    # Page numbers with gaps: the pages in between are missing.
    pages = read(spark, sf, "conversations").select("conv_id", (F.col("turn") * 2 + F.col("turn") % 3).cast("long").alias("turn"), "text")
    return store.pages_joined(pages, "conv_id", "turn", "text").select("conv_id", "n_pages", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


@query("distinct_pages", "SELECT conv_id, count(DISTINCT turn) AS pages FROM conversations GROUP BY conv_id")
def distinct_pages(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count_distinct("turn").alias("pages"))


@query("anti_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark, sf):
    return store.pending(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), ["doc_id"])


@query("semi_by_tag", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_by_tag(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("tag_merge", "WITH s AS (SELECT sha256(text) AS uuid, unnest([lang, source]) AS tag FROM documents) SELECT uuid, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM s GROUP BY uuid")
def tag_merge(spark, sf):
    docs = read(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("uuid"), "lang", "source")
    return store.merged_tags(docs, "uuid", F.array("lang", "source")).withColumn("tags", F.array_join("tags", ","))


@query("all_or_nothing", "SELECT source, n_chars, count(*) AS n FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels) ON doc_id = k GROUP BY source, n_chars HAVING count(*) = count(k)")
def all_or_nothing(spark, sf):
    docs = read(spark, sf, "documents").select(F.struct("source", "n_chars").alias("g"), "doc_id")
    return store.complete_groups(docs, read(spark, sf, "labels"), "g", "doc_id").select("g.source", "g.n_chars", "n")


@query("patch_metadata", "SELECT c_custkey, CASE WHEN k IS NOT NULL THEN s ELSE c_mktsegment END AS segment FROM customer LEFT JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS s FROM supplier) ON c_custkey = k")
def patch_metadata(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    patch = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")).alias("segment"))
    return store.patched(rows, patch, "key", ["segment"]).select(F.col("key").alias("c_custkey"), "segment")


@query("store_upsert", "WITH n AS (SELECT c_custkey * 2 AS k, c_name AS v FROM customer) SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def store_upsert(spark, sf):
    old = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    # Every other key of the store, and keys that it lacks.
    new = read(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("v"))
    return store.upsert(store.upsert(old, new, ["k"]), new, ["k"])


@query("dataset_fingerprint", """WITH z AS (SELECT sha256(doc_id || chr(31) || lang || chr(31) || source) AS b, count(*) AS n FROM documents GROUP BY 1),
l6 AS (SELECT left(b, 6) AS c, sha256(string_agg(b || ':' || n, chr(30) ORDER BY b || ':' || n)) AS h, sum(n) AS n FROM z GROUP BY 1),
l4 AS (SELECT left(c, 4) AS d, sha256(string_agg(c || ':' || h, chr(30) ORDER BY c || ':' || h)) AS h, sum(n) AS n FROM l6 GROUP BY 1),
l2 AS (SELECT left(d, 2) AS e, sha256(string_agg(d || ':' || h, chr(30) ORDER BY d || ':' || h)) AS h, sum(n) AS n FROM l4 GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(e || ':' || h, chr(30) ORDER BY e || ':' || h)) AS fingerprint FROM l2""")
def dataset_fingerprint(spark, sf):
    return store.fingerprint(read(spark, sf, "documents"), [F.col("doc_id").cast("string"), F.col("lang"), F.col("source")])


@query("garbled_detection", """WITH h AS (SELECT doc_id, regexp_extract_all(left(hex(encode(CASE n_chars % 3 WHEN 0 THEN repeat(chr(1), 40) || text WHEN 1 THEN repeat(chr(11) || chr(127), 26) || text ELSE text END)), 1000), '..') AS b FROM documents)
SELECT doc_id, coalesce(len(list_filter(b, lambda x: NOT list_contains(['09', '0A', '0B', '0C', '0D', '20'], x))) > 0 AND len(list_filter(b, lambda x: x < '20' AND NOT list_contains(['09', '0A', '0D'], x))) > len(b) * 0.1, false) AS garbled FROM h""")
def garbled_detection(spark, sf):
    kind = F.col("n_chars") % 3
    junk = F.when(kind == 0, F.lit("\x01" * 40)).when(kind == 1, F.lit("\x0b\x7f" * 26)).otherwise("")
    docs = read(spark, sf, "documents").select("doc_id", F.concat(junk, "text").alias("t"))
    return docs.select("doc_id", text.is_garbled(F.col("t")).alias("garbled"))


@query("url_to_path", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || '.PDF', '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/*', ''), '[?#].*$', ''), '(?i)\.(pdf|docx?)$', '.txt') AS path FROM pages")
def url_to_path(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.url_to_path(F.concat("url", F.lit(".PDF"))).alias("path"))


@query("stem_join_fallback", """WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') WHEN 1 THEN lpad((c_custkey % 200)::VARCHAR, 6, '0') ELSE 'doc_' || 'Supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') || '_e' END AS stem FROM customer)
SELECT c_custkey, coalesce(e.s_suppkey, (SELECT s_suppkey FROM supplier f WHERE contains(f.s_name, s.stem) OR contains(s.stem, f.s_name) ORDER BY f.s_name LIMIT 1)) AS s_suppkey FROM s LEFT JOIN supplier e ON e.s_name = s.stem""")
def stem_join_fallback(spark, sf):
    k = (F.col("c_custkey") % 200).cast("string")
    name = F.concat(F.lit("Supplier#"), F.lpad(k, 9, "0"))
    rows = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, name).when(F.col("c_custkey") % 3 == 1, F.lpad(k, 6, "0")).otherwise(F.concat(F.lit("doc_"), name, F.lit("_e"))).alias("stem"))
    return lookup.by_stem(rows, read(spark, sf, "supplier"), "stem", "s_name", "s_suppkey").select("c_custkey", "s_suppkey")


@query("naive_censor")
def naive_censor(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.censor(F.col("text"), ["the", "of the", "anan", "US"], case_sensitive=frozenset({"US"})).cast("binary"), 256).alias("text_sha"))


@query("sentence_chunks")
def sentence_chunks(spark, sf):
    chunks = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.sentence_chunks()("text")).alias("chunk_num", "c"))
    return chunks.select("conv_id", "turn", "chunk_num", "c.start", "c.end", F.sha2(F.col("c.chunk").cast("binary"), 256).alias("chunk_sha"))


@query("span_censor")
def span_censor(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("chunks", text.sentence_chunks(2)("text"))
    spans = F.transform("chunks", lambda c, k: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(k % 2 == 0, F.array(F.lit("the"), F.lit("de la"))).otherwise(F.array().cast("array<string>")).alias("phrases")))
    return rows.select("conv_id", "turn", F.sha2(text.censor_spans()("text", spans).cast("binary"), 256).alias("text_sha"))


@query("fuzzy_mentions")
def fuzzy_mentions(spark, sf):
    terms = ["stupid", "united kingdom", "norway", "licence"]
    return read(spark, sf, "benchmark").select("item_id", text.fuzzy_mentions(terms)("text").alias("mentioned"))


@query("base_rate_bce", """WITH l AS (SELECT 'quality' AS label, quality::DOUBLE AS y FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels), r AS (SELECT label, avg(y) AS rate FROM l GROUP BY label)
SELECT label, round(rate, 9) AS rate, round(-(CASE WHEN rate > 0 THEN rate * ln(rate) ELSE 0 END + CASE WHEN rate < 1 THEN (1 - rate) * ln(1 - rate) ELSE 0 END), 9) AS entropy FROM r""")
def base_rate_bce(spark, sf):
    return evaluation.base_rate_entropy(read(spark, sf, "labels"), ["quality", "toxic"]).select("label", F.round("rate", 9).alias("rate"), F.round("entropy", 9).alias("entropy"))


@query("label_metrics", """WITH r AS (SELECT lang, quality AS y, (n_chars > 1500)::INT AS p FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg((y = p)::INT), 9) AS accuracy, round(coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 0), 9) AS precision, round(coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 0), 9) AS recall FROM r GROUP BY lang""")
def label_metrics(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("p")).join(read(spark, sf, "labels"), "doc_id")
    return evaluation.label_metrics(rows, "quality", "p", "lang").select("lang", "n", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")))


@query("variant_expansion", "SELECT doc_id, v AS variant, s AS space FROM documents CROSS JOIN (VALUES ('raw'), ('naive'), ('llm')) a(v) CROSS JOIN (VALUES ('full'), ('orthogonal')) b(s) WHERE NOT (v = 'llm' AND doc_id % 2 = 0)")
def variant_expansion(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ["raw", "naive", "llm"]))).alias("variant")).where("not (variant = 'llm' and doc_id % 2 = 0)").withColumn("space", F.explode(F.array(F.lit("full"), F.lit("orthogonal"))))


@query("ctfidf_labels", """WITH d AS (SELECT item_id, item_id % 5 AS topic, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark), p AS (SELECT topic, item_id, word, count(*) AS n FROM d WHERE length(word) >= 2 GROUP BY ALL),
w AS (SELECT word, sum(n) AS uses, count(*) AS df FROM p GROUP BY word HAVING count(*) >= 2), c AS (SELECT topic, p.word, sum(n) AS n, any_value(uses) AS uses FROM p JOIN w USING (word) GROUP BY ALL), s AS (SELECT topic, sum(n) AS total FROM c GROUP BY topic),
r AS (SELECT topic, word, round(n / total * ln(1 + (SELECT avg(total) FROM s) / uses), 9) AS score FROM c JOIN s USING (topic))
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word)::INT AS rank, word, score FROM r QUALIFY rank <= 4""")
def ctfidf_labels(spark, sf):
    docs = read(spark, sf, "benchmark").withColumn("topic", F.col("item_id") % 5)
    return topics.word_labels(docs, "topic", "text")


@query("authorship_classifier")
def authorship_classifier(spark, sf):
    labels = ["y0", "y1", "y2"]
    rows = t.vectors(spark, sf).withColumns({"doc": F.floor(F.col("id") / 2), **{y: (F.col("topic") % 3 == k).cast("int") for k, y in enumerate(labels)}}).withColumn("part", classify.split("doc"))
    model = classify.fit(rows.where("part <> 'test'"), "vector", labels, "logistic", 8)
    scored = classify.per_document(model.scores(rows.where("part = 'test'"), "vector"), "doc", labels)
    return classify.cross_entropy(scored, labels).select("label", "n", F.round("loss", 6).alias("loss"))


@query("embedding_store_fill", "SELECT sha256(text) AS uuid, true AS unit FROM (SELECT DISTINCT text FROM benchmark WHERE trim(text) <> '')")
def embedding_store_fill(spark, sf):
    parts = embedding.with_segments(read(spark, sf, "benchmark"), "item_id", "text")
    empty = spark.createDataFrame([], "uuid string, embedding array<double>")
    filled = embedding.embed_missing(parts, empty)
    return filled.select("uuid", (F.abs(vectors.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-9).alias("unit"))
