"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from check_oracles import compare
from retail_spark.llm import byte_bpe, components, decontamination, packing, quality_classifier, secret_scan, sharding, simhash
from tests.conftest import SF_SMALL


def key(r):
    return tuple((x is not None, x) for x in r)


# ---- packing ----------------------------------------------------------------

def slow_best_fit(lengths, row):
    free, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(row - lengths[i])
        out.append(None)
    return Counter(free)


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for row in (1, 7, 16, 100):
        for n in (0, 1, 30, 200):
            lengths = rng.integers(0, row + 1, n).tolist()
            rows = packing.best_fit_decreasing(lengths, row)
            assert sorted(i for r in rows for i in r) == list(range(n))
            assert Counter(row - sum(lengths[i] for i in r) for r in rows) == slow_best_fit(lengths, row)


def test_packed_ids_are_lossless(spark, edge_dir, edge_docs, monkeypatch):
    enc = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = Counter((d[0], enc.encode([d[1]])[0]) for d in edge_docs)
    parts = defaultdict(list)
    for m in packing.query(spark, edge_dir).collect():
        ids = np.frombuffer(m["ids"], dtype="<u2").reshape(m["n_rows"], m["row_length"])
        assert m["n_rows"] <= packing.BLOCK and m["n_tokens"] == sum(c[-1] for c in m["cu_seqlens"])
        for row, cu, resets, docs, starts in zip(ids, m["cu_seqlens"], m["position_resets"], m["doc_ids"], m["doc_starts"]):
            assert cu[0] == 0 and cu == sorted(cu) and cu[-1] <= packing.ROW and (row[cu[-1]:] == 50256).all()
            assert resets == sorted({a for a, b in zip(cu, cu[1:]) if b > a}) and len(cu) == len(docs) + 1 == len(starts) + 1
            for k, doc in enumerate(docs):
                parts[doc].append((starts[k], row[cu[k]:cu[k + 1]].astype("<u4").tobytes()))
    single = {d: n for d, n in Counter(d for d, _ in want.elements()).items() if n == 1}
    for (doc, ids), n in want.items():
        if doc in single:
            assert b"".join(x[1] for x in sorted(parts[doc])) == ids
    assert sum(map(len, (x[1] for v in parts.values() for x in v))) == sum(len(k[1]) * n for k, n in want.items())


# ---- sharding ---------------------------------------------------------------

def slow_capacity(sizes, shards):
    def fits(c):
        used, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                used, fill = used + 1, 0
            fill += s
        return used <= shards
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("summary", [sharding.SUMMARY, 1])
def test_sharding_is_minimax(spark, edge_dir, edge_docs, monkeypatch, summary):
    monkeypatch.setattr(sharding, "SUMMARY", summary)
    got = sharding.shard(spark.read.parquet(f"{edge_dir}/documents.parquet"), 3).collect()
    groups = defaultdict(int)
    for d in edge_docs:
        groups["" if d[1] is None else hashlib.md5(d[1].encode()).hexdigest()] += len((d[1] or "").encode()) + 16
    sizes = [groups[g] for g in sorted(groups)]
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert max(sum(r["size"] for r in v) for v in by.values()) == slow_capacity(sizes, 3)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    want = sorted(((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in edge_docs), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == want
    assert len({r["shard"] for r in got if r["doc_id"] in (900_005, 900_006)}) == 1      # equal texts stay together


def test_sharding_query_and_few_groups(spark, edge_dir):
    assert sharding.query(spark, edge_dir).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    one = sharding.shard(spark.createDataFrame([(i, "same", "x") for i in range(5)], "doc_id int, text string, SHARD string"), 40).collect()
    assert {r["shard"] for r in one} == {0} and sorted(r["slot"] for r in one) == list(range(5))


def test_minimax_search_on_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUMMARY", 1)
    rng = np.random.default_rng(4)
    for sizes in ([5] * 300, [1000, *[17] * 400], rng.integers(16, 9000, 500).tolist(), [*rng.integers(16, 40, 300).tolist(), 20_000, *[16] * 100]):
        upto = np.cumsum(sizes).tolist()
        groups = spark.createDataFrame(list(zip(sizes, upto, range(1, len(sizes) + 1))), "size long, upto long, rows long").cache()
        ends, capacity = sharding.minimax(groups, 3)
        assert capacity == slow_capacity(sizes, 3)
        at = [0, *[ends.at[i] for i in sharding.even_cuts(ends, capacity, 3)]]
        assert at[-1] == upto[-1] and max(b - a for a, b in zip(at, at[1:])) == capacity and set(at[1:]) <= set(upto)


# ---- simhash ----------------------------------------------------------------

def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def slow_components(prints, bits):
    """prints: (id, fingerprint) -> fingerprint: smallest id reachable."""
    own, seen = sorted({p for _, p in prints}), {}
    for p in own:
        if p in seen:
            continue
        todo, group = [p], {p}
        while todo:
            x = todo.pop()
            for y in own:
                if y not in group and (x ^ y).bit_count() <= bits:
                    group.add(y)
                    todo.append(y)
        least = min((i for i, q in prints if q in group and i is not None), default=None)
        seen.update(dict.fromkeys(group, least))
    return seen


def test_fingerprints_and_components(spark, edge_dir, edge_docs):
    prints = [(d[0], slow_print(d[1])) for d in edge_docs]
    least = slow_components(prints, 4)
    want = sorted(((i, f"{p:016x}", least[p]) for i, p in prints), key=key)
    assert sorted((tuple(r) for r in simhash.query(spark, edge_dir).collect()), key=key) == want


def near(rng, n, flips):
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    out = []
    for _ in range(n):
        x = int(rng.choice(base)) if rng.random() < 0.7 else int(rng.integers(0, 1 << 63))
        for b in rng.integers(0, 64, flips):
            x ^= 1 << int(b)
        out.append(x & (1 << 64) - 1)
    return sorted(set(out))


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_trie_join_finds_every_component(bits):
    rng = np.random.default_rng(bits)
    v = near(rng, 400, 3)
    a = np.array(v, dtype=np.uint64)
    x, y = simhash.join_tries(a, None, 0, bits, bits)
    parent = {p: p for p in v}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for p, q in zip(x.tolist(), y.tolist()):
        assert (p ^ q).bit_count() >= 1
        parent[max(find(p), find(q))] = min(find(p), find(q))
    want = slow_components([(p, p) for p in v], bits)
    assert {p: find(p) for p in v} == want


@pytest.mark.parametrize("cell", [simhash.CELL, 20])
def test_dealt_trie_join(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)      # 20: many subtrees, and hot ones in chunks
    v = near(np.random.default_rng(9), 500, 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    got = simhash.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long"), 4).collect()
    group = defaultdict(set)
    for r in got:
        group[r["root"]].add(r["node"] & (1 << 64) - 1)
    want = defaultdict(set)
    for p, root in slow_components([(p, p) for p in v], 4).items():
        want[root].add(p)
    assert sorted(map(sorted, group.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(201, 200), (200, 201), (300, 300)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(80)}, 200: 200, 201: 200}


def test_one_row_of_each_component_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (None, "something else entirely is here", "d"), (2, "another text with id two here", "e"), (9, None, "f"), (8, "", "g")]
    got = sorted(r["id_key"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id int, text string, id_key string")).collect())
    assert got == ["b", "d", "e", "g"]


# ---- decontamination --------------------------------------------------------

ITEMS = [(1, "A farmer named John has 12 apples and gives 5 apples to Mary, so how many apples does John keep?"), (2, "too short"), (3, None), (4, ""),
         (5, "The quick brown fox jumps over the lazy dog while seven birds watch from the old garden wall.")]
TEXTS = [
    (1, "Intro words here. A farmer named Peter has 30 apples and gives 7 apples to Susan, so how many apples does Peter keep? More."),   # other names, numbers
    (2, "A farmer named Peter has 30 apples and gives 7 apples to Susan, so how many apples does Susan keep?"),     # one slot, two values
    (3, "Nothing of the kind. Just a farmer with apples and a long story about the weather in spring."), (4, None), (5, ""),
    (None, "Look: THE QUICK BROWN FOX jumps over the lazy dog, while 7 birds watch from the old garden wall!"),
    (7, "The quick brown fox jumps over a sleeping cat while nobody watches."), (1, "Same id, clean text for once, nothing to see here at all."),
]


def test_reparameterised_questions(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in TEXTS] * 2, "doc_id int, text string, item int, _hit_id string")
    found = decontamination.contaminated(docs, spark.createDataFrame(ITEMS, "item_id int, text string"))
    assert sorted(((r["id"], r["item"]) for r in found.collect()), key=key) == [(None, 5), (1, 1)]
    kept = decontamination.clean(docs, found)
    assert kept.columns == docs.columns and sorted(Counter(r["text"] for r in kept.collect()).items(), key=str) == sorted(
        Counter({t: 2 for k, (i, t) in enumerate(TEXTS) if k not in (0, 5)}).items(), key=str)


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(ITEMS, "item_id int, text string"))
    assert sorted(((r["id"], r["item"]) for r in found.collect()), key=key) == [(None, 5), (1, 1)]


LONG_ITEM = (1, "On the way home a farmer named John has 12 apples in one large basket and gives 5 apples to Mary near the old stone bridge, "
                "so how many apples does the farmer John keep in the basket after the walk?")


def found_ids(spark, texts, items):
    found = decontamination.contaminated(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    return sorted((r["id"], r["item"]) for r in found.collect())


def test_slots_are_read_along_every_alignment(spark):
    item = LONG_ITEM[1]
    other = item.replace("John", "Peter").replace("Mary", "Susan").replace("12", "30")
    decoy = other.replace("farmer Peter", "farmer Susan")
    texts = [(1, other), (2, other.replace("old stone", "old grey stone")), (3, other.replace("large ", "")), (4, f"{decoy} {other}"), (5, f"{other} {decoy}"),
             (6, decoy), (7, decoy.replace("old stone", "old grey stone")), (8, f"{decoy} Some words. {decoy}")]
    assert found_ids(spark, texts, [LONG_ITEM]) == [(k, 1) for k in (1, 2, 3, 4, 5)]


def test_names_that_open_sentences_and_runs_of_placeholders(spark):
    item = "Anna has 25 apples in a basket. Anna gives 5 apples to John at the gate. How many apples are left?"
    texts = [(1, item.replace("Anna", "Zoe")), (2, item.replace("25", "twenty five").replace("Anna", "Zoe")), (3, item.replace("John", "Mary Ann")),
             (4, item.replace("Anna has", "Zoe has").replace("Anna gives", "Carl gives")), (5, "Question: " + item.replace("Anna", "Mary Ann")),
             (6, "\x01Anna sings. PETER's O'Brien-Smith, NASA; DeShawn: JEAN-LUC. İpek and I5 walk home, Anna's \u01c5 THE end. Five days pass.")]
    assert found_ids(spark, texts, [(1, item)]) == [(k, 1) for k in (1, 2, 3, 5)]
    both = spark.createDataFrame(texts + TEXTS, "doc_id int, text string").select(
        decontamination.template(F.col("text")).alias("a"), decontamination._plain(decontamination._marked(F.col("text"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    sides = [decontamination.read(spark.createDataFrame(texts + TEXTS, "doc_id int, text string").select("text", F.col("text").alias("kept")), r)
             .select(F.concat_ws(" ", "words").alias("k"), decontamination._windows(F.col("words"), r).alias("w"), "kept").collect() for r in (0, 1)]
    sent = spark.createDataFrame(texts + TEXTS, "doc_id int, text string").select(decontamination._sent(F.col("text")).alias("h")).collect()
    assert [r["h"] for r in sent] == [a["w"] + b["w"] for a, b in zip(*sides)]


def test_names_of_every_spelling(spark):
    item = LONG_ITEM[1]
    texts = [(k, item.replace("John", name)) for k, name in enumerate(("PETER", "Jean-Luc", "O'Brien", "DeShawn", "McDonald", "Marie-Luise-Anna", "O’Neil"))]
    texts += [(20, item.replace("farmer John", "farmer DeShawn")), (21, item.replace("farmer John", "farmer Jean-Luc"))]
    assert found_ids(spark, texts, [LONG_ITEM]) == [(k, 1) for k in range(7)]


def test_asides_of_any_length_in_items_that_repeat_a_window(spark):
    item = ("In the first year John sold 12 apples at the market and in the first year Mary sold 5 apples at the big fair by the sea, "
            "so how many apples did both of them sell in all of that time together when nothing else was sold?")
    other = item.replace("John", "Peter").replace("Mary", "Susan").replace("12", "30").replace("5", "7")
    wrong = item.replace("John", "Peter").replace("12", "30").replace("5", "30")
    aside = "which was well known to all of us here but never said aloud by any of the people who lived there then".split()
    texts = [(n, other.replace(" by the sea", " " + " ".join(aside[:n]) + " by the sea")) for n in range(len(aside) + 1)]
    texts += [(100 + n, other.replace(" market", " " + " ".join(aside[:n]) + " market")) for n in range(len(aside) + 1)]
    same = "John met John. " + item
    assert found_ids(spark, texts, [(1, item)]) == [(k, 1) for k, _ in texts]
    assert found_ids(spark, [(1, wrong + " " + other), (2, same.replace("John met John", "Peter met Susan").replace("year John", "year Peter"))], [(1, same)]) == [(1, 1)]


def test_items_without_windows_are_found_word_for_word(spark, monkeypatch):
    items = [(1, "12 + 7 = 19"), (2, "Anna, Ben, Carl, Dora, Emil"), (3, "What is DNA?"), (4, "Paris"), (5, " "), (None, "Anna, Ben, Carl"), (6, None)]
    texts = [(1, "We know: 12+7 = 19."), (2, "We know: 12 + 8 = 19."), (3, "Meet Anna, Ben, Carl, Dora, Emil and Fay"), (4, "Meet Anna, Ben, Dora, Carl, Emil"),
             (5, "So\nwhat is\tDNA?"), (6, "Paris"), (7, "12, 7, 19"), (8, None), (9, "")]
    assert found_ids(spark, texts, items) == [(1, 1), (3, 2), (5, 3)]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    rng = np.random.default_rng(5)
    lists = lambda n, low, high: [" ".join(rng.choice(["1", "2"], rng.integers(low, high))) for _ in range(n)]
    items, texts = list(enumerate(lists(40, 3, 14))), list(enumerate(lists(30, 0, 40)))
    brute = sorted((d, i) for d, text in texts for i, item in items if f" {item} " in f" {text} ")
    assert brute and found_ids(spark, texts, items) == brute


def test_decontamination_matches_the_sql_twin(spark, edge_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert compare(decontamination.query(spark, SF_SMALL).toPandas(), con.sql(decontamination.SQL).df()) is None
    bench = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()]
    for r in decontamination.query(spark, edge_dir).join(spark.read.parquet(f"{edge_dir}/documents.parquet").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r["contaminated"] or not any(b in (r["text"] or "") for b in bench)


# ---- pipeline ---------------------------------------------------------------

def test_pipeline_equals_brute_force(spark, edge_dir, edge_docs):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    model = quality_classifier.fit(docs, quality_classifier.ratings_of(spark.read.parquet(f"{edge_dir}/labels.parquet")), 3)
    good = [d for d in dict.fromkeys(edge_docs) if 1 / (1 + np.exp(model.thresholds[0] - float(quality_classifier.vector(d[1]) @ model.weights))) >= 0.5]
    prints = {d: slow_print(d[1]) for d in good}
    least = slow_components([((d[0] is None, d[0], d[1]), p) for d, p in prints.items()], 4)
    kept = [d for d in good if (d[0] is None, d[0], d[1]) == least[prints[d]]]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{edge_dir}/documents.parquet' WHERE doc_id IS NOT NULL")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{edge_dir}/benchmark.parquet'")
    bad = {i for (i,) in con.sql(f"SELECT doc_id FROM ({decontamination.SQL}) WHERE contaminated").fetchall()}
    kept = [d for d in kept if d[0] not in bad]
    owners = defaultdict(set)
    for d in kept:
        for s in secret_scan.find_spans(d[1]):
            owners[s["value_hash"]].add(d[3] or "")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d in kept:
        text = d[1] or ""
        for s in reversed([s for s in secret_scan.find_spans(text) if s["random"] and len(owners[s["value_hash"]]) < 3]):
            if text[s["value_start"]:s["value_end"]] == (d[1] or "")[s["value_start"]:s["value_end"]]:
                text = text[:s["value_start"]] + "<secret>" + text[s["value_end"]:]
        ids = enc.encode_ordinary(text)
        want.append((d[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, edge_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pipeline_stages_keep_the_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").withColumns({c: F.lit("own") for c in ("tail_1", "secrets", "_spans", "fp", "item")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == docs.columns
        assert out.filter("tail_1 = 'own' AND secrets = 'own' AND item = 'own'").count() == out.count() > 0
