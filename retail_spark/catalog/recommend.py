"""Recommendation queries over baskets of sections (fixture: min support
0.001, min confidence 0.05, min lift 1.0; customer × section interactions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.functions import exprs as X
from retail_spark.catalog.segments import cte
from retail_spark.plans import factors as N
from retail_spark.plans import recommend as RC
from retail_spark.session import cut_lineage

MIN_SUPPORT, MIN_CONF, MIN_LIFT = 0.001, 0.05, 1.0
TOP_N = 5
# Fixed expected affinity pairs checked against the rules (DP5).
EXPECTED_PAIRS = [("Brand#1", "Brand#2"), ("Brand#10", "Brand#11"), ("Brand#3", "Brand#7"),
                  ("Brand#12", "Brand#24"), ("Brand#5", "Brand#9")]


def _baskets(t):
    return RC.baskets(t.valid_lines, "section")


def _rules(t):
    return RC.rules(_baskets(t), MIN_SUPPORT, MIN_CONF, MIN_LIFT)


def _hist(t):
    return t.valid_lines.select("customer_id", F.col("section").alias("item")).distinct()


def _inter(t, item="section"):
    return t.valid_lines.groupBy("customer_id", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("count"))


# SQL twins ---------------------------------------------------------------------

COUNTS = """
bask AS (SELECT DISTINCT order_id, section AS item FROM valid_lines),
nb AS (SELECT count(DISTINCT order_id) AS n FROM bask),
kk AS (SELECT greatest(1, CAST(floor(0.001 * n) AS BIGINT)) AS k FROM nb),
c1 AS (SELECT item, count(*) AS cnt FROM bask GROUP BY item HAVING count(*) >= (SELECT k FROM kk)),
c2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS cnt FROM bask a JOIN bask b
       ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= (SELECT k FROM kk)),
c3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS cnt FROM bask a
       JOIN bask b ON a.order_id = b.order_id AND a.item < b.item
       JOIN bask c ON a.order_id = c.order_id AND b.item < c.item GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT k FROM kk))"""

RULES = """
rr AS (
  SELECT [p.i1] AS antecedent, p.i2 AS consequent, p.cnt / n AS support, p.cnt / a.cnt AS confidence,
         (p.cnt / a.cnt) / (c.cnt / n) AS lift, p.cnt AS count
  FROM c2 p JOIN c1 a ON a.item = p.i1 JOIN c1 c ON c.item = p.i2, nb
  UNION ALL
  SELECT [p.i2], p.i1, p.cnt / n, p.cnt / a.cnt, (p.cnt / a.cnt) / (c.cnt / n), p.cnt
  FROM c2 p JOIN c1 a ON a.item = p.i2 JOIN c1 c ON c.item = p.i1, nb
  UNION ALL
  SELECT [t.i1, t.i2], t.i3, t.cnt / n, t.cnt / a.cnt, (t.cnt / a.cnt) / (c.cnt / n), t.cnt
  FROM c3 t JOIN c2 a ON a.i1 = t.i1 AND a.i2 = t.i2 JOIN c1 c ON c.item = t.i3, nb
  UNION ALL
  SELECT [t.i1, t.i3], t.i2, t.cnt / n, t.cnt / a.cnt, (t.cnt / a.cnt) / (c.cnt / n), t.cnt
  FROM c3 t JOIN c2 a ON a.i1 = t.i1 AND a.i2 = t.i3 JOIN c1 c ON c.item = t.i2, nb
  UNION ALL
  SELECT [t.i2, t.i3], t.i1, t.cnt / n, t.cnt / a.cnt, (t.cnt / a.cnt) / (c.cnt / n), t.cnt
  FROM c3 t JOIN c2 a ON a.i1 = t.i2 AND a.i2 = t.i3 JOIN c1 c ON c.item = t.i1, nb),
rules AS (SELECT * FROM rr WHERE confidence >= 0.05 AND lift >= 1.0)"""

PRUNED = """
singles AS (SELECT antecedent[1] AS item, consequent, confidence AS c1, lift AS l1 FROM rules WHERE len(antecedent) = 1),
dropped AS (SELECT DISTINCT r.antecedent, r.consequent FROM rules r JOIN singles s
            ON list_contains(r.antecedent, s.item) AND s.consequent = r.consequent
            WHERE len(r.antecedent) = 2 AND (s.c1 > r.confidence OR (s.c1 = r.confidence AND s.l1 >= r.lift))
              AND abs(r.confidence - s.c1) / s.c1 < 0.10),
pruned AS (SELECT r.* FROM rules r WHERE NOT EXISTS (
            SELECT 1 FROM dropped d WHERE d.antecedent = r.antecedent AND d.consequent = r.consequent))"""

HIST = "hist AS (SELECT DISTINCT customer_id, section AS item FROM valid_lines)"

RULE_RECS = """
hb AS (SELECT customer_id, list(item) AS basket FROM hist GROUP BY customer_id),
m AS (SELECT h.customer_id, r.consequent AS item, max(r.confidence * r.lift) AS score
      FROM hist h JOIN pruned r ON r.antecedent[1] = h.item JOIN hb ON hb.customer_id = h.customer_id
      WHERE list_has_all(hb.basket, r.antecedent) AND NOT list_contains(hb.basket, r.consequent) GROUP BY 1, 2),
fp_recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item) AS rank FROM m))"""

SIM = """
inter AS (SELECT customer_id, section AS item, count(*) AS count FROM valid_lines GROUP BY 1, 2),
norms AS (SELECT item, sqrt(sum(count * count)) AS nrm FROM inter GROUP BY item),
dots AS (SELECT a.item AS item_a, b.item AS item_b, sum(a.count * b.count) AS dot FROM inter a JOIN inter b
         ON a.customer_id = b.customer_id AND a.item < b.item GROUP BY 1, 2),
sim AS (SELECT item_a, item_b, dot / (na.nrm * nb.nrm) AS similarity FROM dots
        JOIN norms na ON na.item = item_a JOIN norms nb ON nb.item = item_b)"""

SIM_RECS = """
both_ AS (SELECT item_a, item_b, similarity FROM sim UNION ALL SELECT item_b, item_a, similarity FROM sim),
sc AS (SELECT h.customer_id, b.item_b AS item, sum(b.similarity) AS score FROM hist h JOIN both_ b
       ON b.item_a = h.item AND b.similarity > 0 GROUP BY 1, 2),
sc2 AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.customer_id = sc.customer_id AND x.item = sc.item)),
sim_recs AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item) AS rank FROM sc2)"""

POP = """
pop AS (SELECT item, count(DISTINCT customer_id) AS buyers,
               row_number() OVER (ORDER BY count(DISTINCT customer_id) DESC, item) AS pop_rank FROM hist GROUP BY item),
pcand AS (SELECT u.customer_id, p.* FROM (SELECT DISTINCT customer_id FROM hist) u, pop p
          WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.customer_id = u.customer_id AND x.item = p.item)),
pop_recs AS (SELECT * FROM (SELECT customer_id, item, CAST(buyers AS DOUBLE) AS score,
                   row_number() OVER (PARTITION BY customer_id ORDER BY pop_rank) AS rank FROM pcand) WHERE rank <= 5)"""


@register("baskets", sql="""
SELECT order_id, list_sort(list(DISTINCT section)) AS items FROM valid_lines GROUP BY order_id""")
def baskets(t):
    """DP1: distinct sections per non-void order."""
    return _baskets(t)


@register("frequent_itemsets", sql=cte(COUNTS) + """
SELECT [item] AS items, cnt AS count, cnt / n AS support, 1 AS size FROM c1, nb
UNION ALL SELECT [i1, i2], cnt, cnt / n, 2 FROM c2, nb
UNION ALL SELECT [i1, i2, i3], cnt, cnt / n, 3 FROM c3, nb""")
def frequent_itemsets(t):
    """DP2: frequent 1-, 2-, 3-itemsets (FP-Growth, floor(support·n) threshold)."""
    return RC.itemsets(_baskets(t), MIN_SUPPORT)


@register("association_rules", sql=cte(COUNTS, RULES) + "SELECT * FROM rules")
def association_rules(t):
    """DP3: rules 1→1 and 2→1 with support, confidence, lift, count."""
    return _rules(t)


@register("pruned_rules", sql=cte(COUNTS, RULES, PRUNED) + "SELECT * FROM pruned")
def pruned_rules(t):
    """DP4: greedy redundancy pruning in exact join form."""
    return RC.prune(_rules(t))


@register("validated_pairs", sql=cte(COUNTS, RULES) + ", e AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in EXPECTED_PAIRS) + """) v(item_a, item_b)),
one AS (SELECT list_sort([antecedent[1], consequent]) AS pair, confidence, lift FROM rules WHERE len(antecedent) = 1)
SELECT e.item_a, e.item_b, count(one.confidence) AS rules_found, max(one.confidence) AS best_confidence,
       max(one.lift) AS best_lift, count(one.confidence) > 0 AS found
FROM e LEFT JOIN one ON one.pair = list_sort([e.item_a, e.item_b]) GROUP BY e.item_a, e.item_b""")
def validated_pairs(t):
    """DP5: expected pairs found as rules in either direction."""
    exp = t.spark.createDataFrame(EXPECTED_PAIRS, "item_a string, item_b string")
    return RC.validate_pairs(_rules(t), exp)


@register("pair_counts", sql="""
WITH bask AS (SELECT DISTINCT order_id, section AS item FROM valid_lines)
SELECT a.item AS item_a, b.item AS item_b, count(*) AS count FROM bask a JOIN bask b
ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2""")
def pair_counts(t):
    """DP6: co-occurrence counts of section pairs (FP-Growth, min count 1)."""
    return RC.pair_counts(_baskets(t))


@register("rules_summary", sql=cte(COUNTS, RULES) + """
SELECT CASE WHEN confidence >= 0.5 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS confidence_band,
       count(*) AS rules, avg(confidence) AS mean_confidence, avg(lift) AS mean_lift, avg(support) AS mean_support
FROM rules GROUP BY 1""")
def rules_summary(t):
    """AG39: rule-set summary by confidence band."""
    return RC.rules_summary(_rules(t))


@register("rule_explanations", sql=cte(COUNTS, RULES) + """
SELECT antecedent, consequent,
       format('Customers who buy {} also buy {} ({:.0f}% confidence, {:.1f}x lift)',
              array_to_string(antecedent, ', '), consequent, confidence * 100, lift) AS explanation,
       CASE WHEN lift >= 1 THEN 1 / (1 + exp(-(lift - 1))) ELSE exp(lift - 1) / (1 + exp(lift - 1)) END AS lift_sigmoid
FROM rules""")
def rule_explanations(t):
    """SF6 explanation sentence of each rule and SF26 stable sigmoid of its lift above one."""
    return _rules(t).select("antecedent", "consequent",
                            X.explain_rule(F.array_join("antecedent", ", "), "consequent", "confidence", "lift").alias("explanation"),
                            X.sigmoid(F.col("lift") - 1).alias("lift_sigmoid"))


@register("rule_recommendations", sql=cte(COUNTS, RULES, PRUNED, HIST, RULE_RECS) + "SELECT * FROM fp_recs WHERE rank <= 5")
def rule_recommendations(t):
    """DP7: rule-based top-5 per customer (whole antecedent in history)."""
    return RC.recommend_rules(_hist(t), RC.prune(_rules(t)), TOP_N)


@register("interactions", sql="""
SELECT customer_id, section AS item, count(*) AS count FROM valid_lines GROUP BY 1, 2""")
def interactions(t):
    """AG30: user-item interaction counts in long form."""
    return _inter(t)


@register("item_popularity", sql="""
SELECT section AS item, count(DISTINCT customer_id) AS buyers, count(DISTINCT order_id) AS orders
FROM valid_lines GROUP BY section""")
def item_popularity(t):
    """AG31: distinct buyers and orders per item."""
    return (t.valid_lines.groupBy(F.col("section").alias("item"))
            .agg(F.countDistinct("customer_id").alias("buyers"), F.countDistinct("order_id").alias("orders")))


@register("item_cosine", sql=cte(SIM) + "SELECT * FROM sim")
def item_cosine(t):
    """DP13: exact item–item cosine similarity on interaction counts."""
    return RC.item_cosine(_inter(t))


NEAR_ITEMS, NEAR_COSINE = 20, 0.05

NEAR = f"""
inter AS (SELECT customer_id, item_id AS item, count(*) AS count FROM valid_lines GROUP BY 1, 2),
norms AS (SELECT item, sqrt(sum(count * count)) AS nrm FROM inter GROUP BY item),
dots AS (SELECT a.item AS item, b.item AS neighbour, sum(a.count * b.count) AS dot FROM inter a JOIN inter b
         ON a.customer_id = b.customer_id AND a.item <> b.item GROUP BY 1, 2),
sims AS (SELECT dots.item, neighbour, dot / (na.nrm * nb.nrm) AS similarity FROM dots
         JOIN norms na ON na.item = dots.item JOIN norms nb ON nb.item = neighbour),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(similarity, 9) DESC, neighbour) AS rank
         FROM sims WHERE similarity >= {NEAR_COSINE}) WHERE rank <= {NEAR_ITEMS})"""


def _near(t):
    return cut_lineage(N.item_neighbours(_inter(t, "item_id"), NEAR_ITEMS, NEAR_COSINE))


@register("item_interactions", sql="""
SELECT customer_id, item_id, count(*) AS count, sum(quantity) AS quantity FROM valid_lines GROUP BY 1, 2""")
def item_interactions(t):
    """AG30 on single items: user-item interaction counts in long form."""
    return t.valid_lines.groupBy("customer_id", "item_id").agg(F.count(F.lit(1)).alias("count"), F.sum("quantity").alias("quantity"))


@register("item_neighbours", sql=cte(NEAR) + "SELECT * FROM near")
def item_neighbours(t):
    """DP13 on single items: the 20 most similar of each, cosine 0.05 or more."""
    return _near(t)


@register("neighbour_recommendations", sql=cte(NEAR) + f"""
, own AS (SELECT DISTINCT customer_id, item_id AS item FROM valid_lines),
sc AS (SELECT customer_id, neighbour AS item, sum(similarity) AS score FROM own JOIN near USING (item) GROUP BY 1, 2),
sc2 AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.customer_id = sc.customer_id AND x.item = sc.item))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, item) AS rank FROM sc2) WHERE rank <= {TOP_N}""")
def neighbour_recommendations(t):
    """DP8 on single items, from the stored neighbours: top five per customer, own items left out."""
    hist = t.valid_lines.select("customer_id", F.col("item_id").alias("item"))
    return N.recommend_neighbours(hist, _near(t), TOP_N)


@register("similar_item_recommendations", sql=cte(HIST, SIM, SIM_RECS) + "SELECT * FROM sim_recs WHERE rank <= 5")
def similar_item_recommendations(t):
    """DP8: similarity-sum top-5 per customer, history excluded."""
    return RC.recommend_similar(_hist(t), RC.item_cosine(_inter(t)), TOP_N)


@register("popular_recommendations", sql=cte(HIST, POP) + "SELECT * FROM pop_recs")
def popular_recommendations(t):
    """DP11: popularity baseline, own items excluded, top-5."""
    return RC.recommend_popular(_hist(t), TOP_N)


CTX = """
ctx AS (SELECT c.price_tier, l.section AS item, CAST(count(*) AS DOUBLE) AS ctx_score
        FROM valid_lines l JOIN customers_v c ON l.customer_id = c.customer_id GROUP BY 1, 2),
mult AS (SELECT *, ctx_score / avg(ctx_score) OVER (PARTITION BY price_tier) AS multiplier FROM ctx)"""


def _ctx(t):
    c = (t.valid_lines.join(t.customers_v.select("customer_id", "price_tier"), "customer_id")
         .groupBy("price_tier", F.col("section").alias("item"))
         .agg(F.count(F.lit(1)).cast("double").alias("ctx_score")))
    return RC.context_multiplier(c, "price_tier")


@register("context_multipliers", sql=cte(CTX) + "SELECT * FROM mult")
def context_multipliers(t):
    """DP10: item score in a price-tier context ÷ mean score in that context."""
    return _ctx(t)


@register("hybrid_recommendations", sql=cte(COUNTS, RULES, PRUNED, HIST, RULE_RECS, SIM, SIM_RECS, CTX) + """
, nh AS (SELECT customer_id, count(DISTINCT item) AS nh FROM hist GROUP BY customer_id),
fpc AS (SELECT customer_id, item, score AS fp FROM fp_recs WHERE rank <= 20),
smc AS (SELECT s.customer_id, s.item, s.score AS sim FROM sim_recs s JOIN nh ON s.customer_id = nh.customer_id
        WHERE s.rank <= 20 AND nh.nh >= 5),
hc AS (SELECT coalesce(f.customer_id, s.customer_id) AS customer_id, coalesce(f.item, s.item) AS item, f.fp, s.sim
      FROM fpc f FULL OUTER JOIN smc s ON f.customer_id = s.customer_id AND f.item = s.item),
hc2 AS (SELECT hc.*, greatest(coalesce(max(fp) OVER (PARTITION BY customer_id), 0.0), 0.001) AS fmax,
              greatest(coalesce(max(sim) OVER (PARTITION BY customer_id), 0.0), 0.001) AS smax FROM hc),
hc3 AS (SELECT hc2.customer_id, hc2.item,
              (0.6 * coalesce(fp, 0.0) / fmax + 0.4 * coalesce(sim, 0.0) / smax) * coalesce(m.multiplier, 1.0) AS score,
              CASE WHEN fp IS NOT NULL AND sim IS NOT NULL THEN 'both' WHEN fp IS NOT NULL THEN 'rules' ELSE 'similarity' END AS source
       FROM hc2 LEFT JOIN customers_v u ON u.customer_id = hc2.customer_id
       LEFT JOIN mult m ON m.price_tier = u.price_tier AND m.item = hc2.item),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item) AS rank FROM hc3) WHERE rank <= 5),
topc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price_tier ORDER BY ctx_score DESC, item) AS r FROM mult) WHERE r <= 5),
fallback AS (SELECT u.customer_id, t.item, t.multiplier AS score, 'context' AS source, t.r AS rank
             FROM customers_v u JOIN topc t ON t.price_tier = u.price_tier
             WHERE u.customer_id NOT IN (SELECT customer_id FROM ranked))
SELECT * FROM ranked UNION ALL SELECT * FROM fallback""")
def hybrid_recommendations(t):
    """DP9: hybrid blend of rule and similarity candidates × context multiplier."""
    hist = _hist(t)
    fp = RC.recommend_rules(hist, RC.prune(_rules(t)), 20)
    sim = RC.recommend_similar(hist, RC.item_cosine(_inter(t)), 20)
    return RC.recommend_hybrid(fp, sim, hist, t.customers_v, _ctx(t), "price_tier", TOP_N)


HOLD = """
hs AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n_,
              row_number() OVER (PARTITION BY customer_id ORDER BY md5(CAST(customer_id AS VARCHAR) || '|' || item), item) AS r_
       FROM hist),
split AS (SELECT customer_id, item, CASE WHEN n_ >= 5 AND r_ <= greatest(1, floor(n_ * 0.2)) THEN 'test' ELSE 'train' END AS split FROM hs),
train AS (SELECT customer_id, item FROM split WHERE split = 'train'),
truth AS (SELECT customer_id, item FROM split WHERE split = 'test')"""

POP_TRAIN = """
pop AS (SELECT item, count(DISTINCT customer_id) AS buyers,
               row_number() OVER (ORDER BY count(DISTINCT customer_id) DESC, item) AS pop_rank FROM train GROUP BY item),
pcand AS (SELECT u.customer_id, p.* FROM (SELECT DISTINCT customer_id FROM train) u, pop p
          WHERE NOT EXISTS (SELECT 1 FROM train x WHERE x.customer_id = u.customer_id AND x.item = p.item)),
recs AS (SELECT * FROM (SELECT customer_id, item, row_number() OVER (PARTITION BY customer_id ORDER BY pop_rank) AS rank
         FROM pcand) WHERE rank <= 5)"""


@register("holdout_split", sql=cte(HIST, HOLD) + "SELECT * FROM split")
def holdout_split(t):
    """WN21: per-user 20 % hold-out (≥ 1) for users with ≥ 5 items, md5 order."""
    return RC.holdout(_hist(t)).select("customer_id", "item", "split")


@register("popularity_rank_metrics", sql=cte(HIST, HOLD, POP_TRAIN) + """
, t AS (SELECT customer_id, count(*) AS nt FROM truth GROUP BY customer_id),
h AS (SELECT r.customer_id, count(*) AS hits, sum(1 / log2(r.rank + 1)) AS dcg FROM recs r
      JOIN truth x ON x.customer_id = r.customer_id AND x.item = r.item GROUP BY r.customer_id),
per AS (SELECT t.customer_id, coalesce(h.hits, 0) / 5 AS p, coalesce(h.hits, 0) / t.nt AS r,
               coalesce(h.dcg, 0.0) / list_sum(list_transform(range(1, least(t.nt, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
        FROM t LEFT JOIN h ON t.customer_id = h.customer_id),
g AS (SELECT count(*) AS users, avg(p) AS precision_at_k, avg(r) AS recall_at_k, avg(ndcg) AS ndcg_at_k FROM per)
SELECT *, CASE WHEN precision_at_k + recall_at_k > 0
               THEN 2 * precision_at_k * recall_at_k / (precision_at_k + recall_at_k) ELSE 0.0 END AS f1_at_k FROM g""")
def popularity_rank_metrics(t):
    """DP12: P@5, R@5, F1@5, NDCG@5 of the popularity baseline on the hold-out."""
    sp = RC.holdout(_hist(t))
    train = sp.filter(F.col("split") == "train").select("customer_id", "item")
    truth = sp.filter(F.col("split") == "test").select("customer_id", "item")
    return RC.rank_metrics(RC.recommend_popular(train, TOP_N), truth, TOP_N)


@register("recommendation_hits", sql=cte(HIST, HOLD, POP_TRAIN) + """
, top AS (SELECT customer_id, list_sort(list(item)) AS top FROM recs GROUP BY customer_id),
held AS (SELECT customer_id, list_sort(list(item)) AS held FROM truth GROUP BY customer_id)
SELECT customer_id, list_sort(list_intersect(top, held)) AS hits, len(list_intersect(top, held)) AS n_hits
FROM top JOIN held USING (customer_id)""")
def recommendation_hits(t):
    """SO4: intersection of top-5 and held-out items per customer."""
    sp = RC.holdout(_hist(t))
    train = sp.filter(F.col("split") == "train").select("customer_id", "item")
    truth = sp.filter(F.col("split") == "test").select("customer_id", "item")
    h = RC.hits(RC.recommend_popular(train, TOP_N), truth, TOP_N)
    return h.withColumn("hits", F.sort_array("hits"))


@register("resolved_names", sql="""
WITH names AS (SELECT upper(' ' || p_name || ' ') AS name FROM part
               UNION SELECT split_part(p_name, ' ', 1) || 'X' FROM part
               UNION SELECT split_part(p_name, ' ', 2) FROM part),
nk AS (SELECT DISTINCT name, lower(trim(name)) AS k FROM names WHERE name IS NOT NULL AND name <> ''),
ck AS (SELECT DISTINCT p_name AS match, lower(trim(p_name)) AS c FROM part),
ex AS (SELECT name, match FROM nk JOIN ck ON k = c),
rest AS (SELECT * FROM nk WHERE name NOT IN (SELECT name FROM ex)),
fz AS (SELECT name, match FROM (SELECT name, match, row_number() OVER (PARTITION BY name ORDER BY match) AS rn
       FROM rest JOIN ck ON contains(c, k) OR contains(k, c)) WHERE rn = 1)
SELECT name, match, 'exact' AS how FROM ex UNION ALL SELECT name, match, 'substring' FROM fz""")
def resolved_names(t):
    """JN14: case/space-insensitive name match, then substring fallback."""
    p = t.raw("part")
    names = (p.select(F.upper(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"))
             .union(p.select(F.concat(F.split("p_name", " ")[0], F.lit("X")).alias("name")))
             .union(p.select(F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("name")))
             .filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct())
    return RC.resolve_names(names, p.select(F.col("p_name").alias("name")))
