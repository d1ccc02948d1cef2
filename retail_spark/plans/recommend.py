"""Recommendation: baskets, frequent itemsets and rules, redundancy pruning,
rule / similarity / hybrid / popularity recommenders, hold-out split and
ranking metrics (DP1–DP13, AG30, AG31, AG39, WN21, SO4, JN14).

Itemsets are counted level by level: pairs of a basket's frequent items, then triples
whose pairs are all frequent.  Item–item cosine of few items uses MLlib's exact
``RowMatrix.columnSimilarities``; ``plans.factors`` has the search for many items.  Every
per-user step is a join on the user key followed by a top-n window per user,
so a user's work is proportional to that user's own rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.operators.ordered import global_row_number
from retail_spark.session import cut_lineage

# Fixed values of the reference blend.
FP_WEIGHT, SIM_WEIGHT = 0.6, 0.4
CANDIDATES_PER_SOURCE = 20
SCORE_FLOOR = 0.001
MIN_HISTORY_FOR_SIM = 5
SALTS = 16                       # copies of a popularity rank that every user joins with
PRUNE_TOLERANCE = 0.10


def baskets(lines: DataFrame, item: str = "section", key: str = "order_id") -> DataFrame:
    """Distinct items per non-void order, sorted (DP1)."""
    return lines.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"))


def min_count(n: int, min_support: float) -> int:
    """Integer floor of support × n, at least 1."""
    return max(1, int(min_support * n))


def _pairs(b: DataFrame, key: str) -> DataFrame:
    """(key, i1, i2) of the item pairs of each basket, i1 < i2 (a basket is an order's lines)."""
    pairs = F.flatten(F.transform("items", lambda x, k: F.transform(
        F.slice("items", k + 2, F.size("items")), lambda y: F.struct(x.alias("i1"), y.alias("i2")))))
    return b.select(key, F.explode(pairs).alias("p")).select(key, "p.i1", "p.i2")


def itemsets(b: DataFrame, min_support: float, key: str = "order_id") -> DataFrame:
    """Frequent 1-, 2- and 3-itemsets with count and support, level by level (DP2).

    A level only looks at sets whose parts were frequent: pairs of baskets cut
    down to frequent items, then triples whose three pairs are frequent.  Counts
    are grouped sums with map-side combining; no set above three is formed."""
    n = b.count()
    least = min_count(n, min_support)
    frequent = lambda d, *by: cut_lineage(d.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least))
    one = frequent(b.select(F.explode("items").alias("i1")), "i1")
    held = cut_lineage(b.select(key, F.explode("items").alias("i1")).join(one.select("i1"), "i1", "left_semi")
                       .groupBy(key).agg(F.sort_array(F.collect_set("i1")).alias("items")))
    two = frequent(_pairs(held, key), "i1", "i2")
    sides = cut_lineage(_pairs(held, key).join(two.select("i1", "i2"), ["i1", "i2"], "left_semi"))
    third = sides.select(key, "i1", F.col("i2").alias("i3"))
    triples = (sides.join(third, [key, "i1"]).filter(F.col("i2") < F.col("i3"))
               .join(two.select(F.col("i1").alias("i2"), F.col("i2").alias("i3")), ["i2", "i3"], "left_semi"))
    three = frequent(triples, "i1", "i2", "i3")
    levels = [one.select(F.array("i1").alias("items"), "count"), two.select(F.array("i1", "i2").alias("items"), "count"),
              three.select(F.array("i1", "i2", "i3").alias("items"), "count")]
    out = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return cut_lineage(out.select("items", "count", (F.col("count") / F.lit(n)).alias("support"), F.size("items").alias("size")))


def rules(b: DataFrame, min_support: float, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules 1→1 and 2→1 with support, confidence, lift, count (DP3), from the frequent itemsets up to size 3."""
    sets = itemsets(b, min_support)
    split = (sets.filter(F.col("size") > 1).select("items", "count", "support", F.explode("items").alias("consequent"))
             .withColumn("antecedent", F.filter("items", lambda x: x != F.col("consequent"))))
    of = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("_na"))
    single = sets.filter(F.col("size") == 1).select(F.col("items")[0].alias("consequent"), F.col("support").alias("_sc"))
    r = (split.join(of, "antecedent").join(single, "consequent")
         .withColumn("confidence", F.col("count") / F.col("_na")).withColumn("lift", F.col("confidence") / F.col("_sc"))
         .filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
         .select("antecedent", "consequent", "support", "confidence", "lift", "count"))
    # rules (bounded by the frequent itemsets) are read by several branches: written once
    return cut_lineage(r)


def prune(r: DataFrame, tol: float = PRUNE_TOLERANCE) -> DataFrame:
    """Greedy redundancy pruning in its exact join form (DP4).

    Rules are visited by (confidence, lift) descending, singles first on full
    ties.  A one-item antecedent can only be covered by itself, so every 1→1
    rule is kept; a 2→1 rule is dropped when a 1→1 rule on one of its items,
    with the same consequent, comes first in that order and has a confidence
    within ``tol`` (relative)."""
    singles = r.filter(F.size("antecedent") == 1).select(
        F.col("antecedent")[0].alias("_item"), "consequent",
        F.col("confidence").alias("_c1"), F.col("lift").alias("_l1"))
    pairs = r.filter(F.size("antecedent") == 2)
    exploded = pairs.select("antecedent", "consequent", "confidence", "lift",
                            F.explode("antecedent").alias("_item"))
    c2, l2 = F.col("confidence"), F.col("lift")
    first = (F.col("_c1") > c2) | ((F.col("_c1") == c2) & (F.col("_l1") >= l2))
    close = F.abs(c2 - F.col("_c1")) / F.col("_c1") < tol
    dropped = (exploded.join(singles, ["_item", "consequent"])
               .filter(first & close).select("antecedent", "consequent").distinct())
    return r.join(dropped, ["antecedent", "consequent"], "left_anti")


def validate_pairs(r: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected pairs found as 1→1 rules in either direction (DP5)."""
    one = r.filter(F.size("antecedent") == 1).select(
        F.sort_array(F.array(F.col("antecedent")[0], F.col("consequent"))).alias("pair"), "confidence", "lift")
    e = expected.select("item_a", "item_b", F.sort_array(F.array("item_a", "item_b")).alias("pair"))
    return (e.join(one, "pair", "left").groupBy("item_a", "item_b")
            .agg(F.count("confidence").alias("rules_found"), F.max("confidence").alias("best_confidence"),
                 F.max("lift").alias("best_lift"))
            .withColumn("found", F.col("rules_found") > 0))


def pair_counts(b: DataFrame, key: str = "order_id") -> DataFrame:
    """Co-occurrence count of every item pair that occurs together (DP6)."""
    return _pairs(b, key).groupBy(F.col("i1").alias("item_a"), F.col("i2").alias("item_b")).agg(F.count(F.lit(1)).alias("count"))


def rules_summary(r: DataFrame) -> DataFrame:
    """Rule count, mean confidence / lift / support by confidence band (AG39)."""
    band = F.when(F.col("confidence") >= 0.5, "high").when(F.col("confidence") >= 0.3, "medium").otherwise("low")
    return r.groupBy(band.alias("confidence_band")).agg(
        F.count(F.lit(1)).alias("rules"), F.avg("confidence").alias("mean_confidence"),
        F.avg("lift").alias("mean_lift"), F.avg("support").alias("mean_support"))


def recommend_rules(hist: DataFrame, r: DataFrame, n: int, user: str = "customer_id") -> DataFrame:
    """Rules whose whole antecedent is in the basket and whose consequent is
    not; score = confidence × lift; best rule per product; top-n (DP7)."""
    rr = r.select(F.col("antecedent")[0].alias("_a0"), "antecedent", "consequent", "confidence", "lift")
    hb = hist.groupBy(user).agg(F.collect_set("item").alias("_basket"))
    first = hist.select(user, F.col("item").alias("_a0"))
    m = (first.join(rr, "_a0").join(hb, user)
         .filter(F.forall("antecedent", lambda x: F.array_contains(F.col("_basket"), x)))
         .filter(~F.array_contains("_basket", F.col("consequent"))))
    best = (m.groupBy(user, F.col("consequent").alias("item"))
            .agg(F.max(F.col("confidence") * F.col("lift")).alias("score")))
    w = Window.partitionBy(user).orderBy(F.desc("score"), F.asc("item"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def item_index(items: DataFrame, item: str = "item") -> DataFrame:
    """Dense 0-based index of items in sorted order (PRJ5)."""
    d = items.select(item).distinct()
    return global_row_number(d, [F.asc(item)], "_rn").select(item, (F.col("_rn") - 1).alias("item_idx"))


def item_cosine(interactions: DataFrame, user: str = "customer_id", item: str = "item",
                value: str = "count") -> DataFrame:
    """Exact item–item cosine similarity of the user × item matrix (DP13),
    via MLlib ``RowMatrix.columnSimilarities`` (upper triangle, i < j)."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    idx = item_index(interactions, item)
    n_items = idx.count()
    rows = (interactions.join(idx, item)
            .groupBy(user).agg(F.collect_list(F.struct("item_idx", F.col(value).cast("double"))).alias("v")))
    vecs = rows.rdd.map(lambda r: Vectors.sparse(n_items, sorted((e[0], e[1]) for e in r.v)))
    sims = RowMatrix(vecs).columnSimilarities()
    spark = interactions.sparkSession
    entries = spark.createDataFrame(sims.entries.map(lambda e: (int(e.i), int(e.j), float(e.value))),
                                    "i long, j long, similarity double")
    a = idx.select(F.col(item).alias("item_a"), F.col("item_idx").alias("i"))
    b = idx.select(F.col(item).alias("item_b"), F.col("item_idx").alias("j"))
    return entries.join(a, "i").join(b, "j").select("item_a", "item_b", "similarity")


def recommend_similar(hist: DataFrame, sim: DataFrame, n: int, user: str = "customer_id") -> DataFrame:
    """Sum of positive similarities from basket items to candidates, basket
    excluded, top-n (DP8)."""
    both = sim.select("item_a", "item_b", "similarity").unionByName(
        sim.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "similarity"))
    h = hist.select(user, F.col("item").alias("item_a")).distinct()
    cand = (h.join(both.filter(F.col("similarity") > 0), "item_a")
            .groupBy(user, F.col("item_b").alias("item")).agg(F.sum("similarity").alias("score")))
    cand = cand.join(h.withColumnRenamed("item_a", "item"), [user, "item"], "left_anti")
    w = Window.partitionBy(user).orderBy(F.desc("score"), F.asc("item"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def context_multiplier(ctx_counts: DataFrame, ctx: str) -> DataFrame:
    """Item score in a context ÷ mean score of all items in it (DP10)."""
    w = Window.partitionBy(ctx)
    return ctx_counts.withColumn("multiplier", F.col("ctx_score") / F.avg("ctx_score").over(w))


def recommend_hybrid(fp: DataFrame, sim: DataFrame, hist: DataFrame, users: DataFrame,
                     mult: DataFrame, ctx: str, n: int, user: str = "customer_id") -> DataFrame:
    """0.6·fp/max + 0.4·sim/max, × context multiplier; similarity only for
    users with ≥ 5 distinct history items; no candidates → context ranking (DP9)."""
    nh = hist.groupBy(user).agg(F.countDistinct("item").alias("_nh"))
    fpc = fp.filter(F.col("rank") <= CANDIDATES_PER_SOURCE).select(user, "item", F.col("score").alias("fp"))
    smc = (sim.filter(F.col("rank") <= CANDIDATES_PER_SOURCE).join(nh, user)
           .filter(F.col("_nh") >= MIN_HISTORY_FOR_SIM).select(user, "item", F.col("score").alias("sim")))
    c = fpc.join(smc, [user, "item"], "full_outer")
    wu = Window.partitionBy(user)
    c = (c.withColumn("_fmax", F.greatest(F.coalesce(F.max("fp").over(wu), F.lit(0.0)), F.lit(SCORE_FLOOR)))
         .withColumn("_smax", F.greatest(F.coalesce(F.max("sim").over(wu), F.lit(0.0)), F.lit(SCORE_FLOOR))))
    blend = (FP_WEIGHT * F.coalesce(F.col("fp"), F.lit(0.0)) / F.col("_fmax")
             + SIM_WEIGHT * F.coalesce(F.col("sim"), F.lit(0.0)) / F.col("_smax"))
    uc = users.select(user, ctx)
    c = (c.join(uc, user, "left").join(mult.select(ctx, "item", "multiplier"), [ctx, "item"], "left")
         .withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))
         .withColumn("score", blend * F.col("multiplier"))
         .withColumn("source", F.when(F.col("fp").isNotNull() & F.col("sim").isNotNull(), "both")
                     .when(F.col("fp").isNotNull(), "rules").otherwise("similarity")))
    w = Window.partitionBy(user).orderBy(F.desc("score"), F.asc("item"))
    ranked = c.select(user, "item", "score", "source").withColumn("rank", F.row_number().over(w)) \
        .filter(F.col("rank") <= n)
    # users without any candidate fall back to their context ranking
    empty = users.select(user, ctx).join(ranked.select(user).distinct(), user, "left_anti")
    wc = Window.partitionBy(ctx).orderBy(F.desc("ctx_score"), F.asc("item"))
    top_ctx = mult.withColumn("_r", F.row_number().over(wc)).filter(F.col("_r") <= n)
    fallback = empty.join(top_ctx, ctx).select(user, "item", F.col("multiplier").alias("score"),
                                                F.lit("context").alias("source"), F.col("_r").alias("rank"))
    return ranked.unionByName(fallback)


def recommend_popular(hist: DataFrame, n: int, user: str = "customer_id") -> DataFrame:
    """Globally most-bought items the user does not own, top-n (DP11).

    Items get a global popularity rank; each user needs at most n + |own|
    ranks, so those ranks are generated per user and equi-joined — no user ×
    item product is formed.  Every user wants the first ranks, so ranks are
    salted: a rank stands ``SALTS`` times on the item side."""
    pop = hist.groupBy("item").agg(F.countDistinct(user).alias("buyers"))
    ranked = global_row_number(pop, [F.desc("buyers"), F.asc("item")], "pop_rank")
    own = hist.select(user, "item").distinct()
    need = own.groupBy(user).agg((F.count(F.lit(1)) + n).alias("_k"))
    wanted = need.select(user, F.pmod(F.xxhash64(user), F.lit(SALTS)).cast("int").alias("_s"),
                         F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("pop_rank"))
    salted = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    cand = wanted.join(salted, ["pop_rank", "_s"]).drop("_s").join(own, [user, "item"], "left_anti")
    w = Window.partitionBy(user).orderBy("pop_rank")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(user, "item", F.col("buyers").cast("double").alias("score"), "rank"))


def holdout(inter: DataFrame, user: str = "customer_id", frac: float = 0.2, min_items: int = 5) -> DataFrame:
    """Per-user hold-out of ``max(1, floor(frac · n))`` items for users with
    ≥ min_items items, chosen in md5 order of (user, item) (WN21)."""
    w = Window.partitionBy(user)
    key = F.md5(F.concat_ws("|", F.col(user).cast("string"), F.col("item")))
    o = Window.partitionBy(user).orderBy(key, F.asc("item"))
    x = (inter.withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn("_r", F.row_number().over(o)))
    test = (F.col("_n") >= min_items) & (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * frac)))
    return x.withColumn("split", F.when(test, "test").otherwise("train")).drop("_n", "_r")


def rank_metrics(recs: DataFrame, truth: DataFrame, k: int, user: str = "customer_id") -> DataFrame:
    """Mean precision@k, recall@k, NDCG@k over users with held-out items;
    F1 from the two means (DP12)."""
    t = truth.groupBy(user).agg(F.count(F.lit(1)).alias("_nt"))
    hits = (recs.filter(F.col("rank") <= k).join(truth.select(user, "item"), [user, "item"])
            .groupBy(user).agg(F.count(F.lit(1)).alias("_hits"),
                               F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg")))
    m = F.least(F.col("_nt"), F.lit(k))
    per = (t.join(hits, user, "left").fillna(0, subset=["_hits"]).fillna(0.0, subset=["_dcg"])
           .select(user, (F.col("_hits") / k).alias("p"), (F.col("_hits") / F.col("_nt")).alias("r"),
                   (F.col("_dcg") / _idcg(m)).alias("ndcg")))
    return mean_metrics(per)


def mean_metrics(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over users (for each ``by``) of p, r and ndcg; F1 from the two means."""
    g = per.groupBy(*by).agg(F.count(F.lit(1)).alias("users"), F.avg("p").alias("precision_at_k"),
                             F.avg("r").alias("recall_at_k"), F.avg("ndcg").alias("ndcg_at_k"))
    p, r = F.col("precision_at_k"), F.col("recall_at_k")
    return g.withColumn("f1_at_k", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def _idcg(m: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))


def metrics_of_tops(rows: DataFrame, held: str, top: str, k: int) -> DataFrame:
    """``rank_metrics`` of each row, which holds a user's held-out items and the ranked ones: p, r, ndcg (DP12)."""
    hit = F.transform(F.slice(top, 1, k), lambda x, i: F.when(F.array_contains(F.col(held), x), 1 / F.log2(i + 2)))
    row = rows.withColumn("_hit", F.filter(hit, lambda x: x.isNotNull()))
    dcg = F.aggregate("_hit", F.lit(0.0), lambda acc, x: acc + x)
    return row.withColumns({"p": F.size("_hit") / k, "r": F.size("_hit") / F.size(held),
                            "ndcg": dcg / _idcg(F.least(F.size(held), F.lit(k)))}).drop("_hit")


def hits(recs: DataFrame, truth: DataFrame, k: int, user: str = "customer_id") -> DataFrame:
    """Top-k ∩ held-out per user (SO4)."""
    top = (recs.filter(F.col("rank") <= k).groupBy(user)
           .agg(F.sort_array(F.collect_list("item")).alias("top")))
    tr = truth.groupBy(user).agg(F.sort_array(F.collect_list("item")).alias("held"))
    return (top.join(tr, user).select(user, F.array_intersect("top", "held").alias("hits"))
            .withColumn("n_hits", F.size("hits")))


GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """The distinct substrings of length ``n``."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))).otherwise(
        F.array().cast("array<string>"))


def contained_pairs(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of the two frames' distinct texts where ``b`` contains ``a``; ``a`` is not empty.

    An inverted index: the long side is listed by its substrings of up to three characters, and a short text looks up
    one of them, the one that fewest long texts hold (itself, if it has fewer than three characters).  A text with a
    part that no long text holds drops out at once; what is left is checked whole."""
    index = long.select(b, F.explode(F.concat(*[_grams(F.col(b), n) for n in range(1, GRAM + 1)])).alias("_g"))
    held = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    parts = short.filter(F.length(a) > 0).select(a, F.when(F.length(a) < GRAM, F.array(a)).otherwise(_grams(F.col(a), GRAM)).alias("_p"))
    looked = (parts.select(a, F.size("_p").alias("_all"), F.explode("_p").alias("_g")).join(held, "_g").groupBy(a, "_all")
              .agg(F.count(F.lit(1)).alias("_known"), F.min(F.struct("_n", "_g")).alias("_r")).filter("_known = _all").select(a, F.col("_r._g").alias("_g")))
    return looked.join(index, "_g").filter(F.col(b).contains(F.col(a))).select(a, b)


def resolve_names(names: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """Case/space-insensitive exact match; otherwise the first catalogue entry
    (alphabetical) where one name contains the other (JN14).  Containment goes
    through an inverted index of trigrams; an empty name is in every other."""
    key = F.lower(F.trim(F.col(name)))
    nk = names.select(name, key.alias("_k")).distinct()
    ck = catalog.select(F.col(name).alias("match"), F.lower(F.trim(F.col(name))).alias("_c")).distinct()
    exact = nk.join(ck, F.col("_k") == F.col("_c")).select(name, "match")
    rest = nk.join(exact.select(name), name, "left_anti")
    first = ck.groupBy("_c").agg(F.min("match").alias("match"))
    texts, entries = rest.select("_k").distinct(), first.select("_c")
    inside = contained_pairs(entries, texts, "_c", "_k").join(first, "_c").groupBy("_k").agg(F.min("match").alias("match"))
    around = contained_pairs(texts, entries, "_k", "_c").join(first, "_c").groupBy("_k").agg(F.min("match").alias("match"))
    blank = texts.crossJoin(F.broadcast(first.filter("_c = ''").select("match")))                                  # one entry at most
    none = texts.filter("_k = ''").crossJoin(F.broadcast(first.agg(F.min("match").alias("match")))).filter("match IS NOT NULL")    # one row
    best = inside.unionByName(around).unionByName(blank.select("_k", "match")).unionByName(none).groupBy("_k").agg(F.min("match").alias("match"))
    fuzzy = rest.join(best, "_k").select(name, "match")
    return exact.withColumn("how", F.lit("exact")).unionByName(fuzzy.withColumn("how", F.lit("substring")))


def idcg(m: int) -> float:
    return sum(1 / math.log2(i + 1) for i in range(1, m + 1))
