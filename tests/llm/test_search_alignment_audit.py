"""Nearest neighbours, tokenizer alignment and the filter audit against brute force and the SQL twins."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from check_oracles import compare
from retail_spark.llm import alignment, filter_audit, hilbert_search
from tests.conftest import SF_SMALL

# ---- nearest neighbours -------------------------------------------------------


@pytest.mark.parametrize("axes,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_search.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def vectors(n=900, dim=12, seed=3):
    """Clusters of unequal norms, copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((9, dim))[rng.integers(0, 9, n)] + 0.3 * rng.standard_normal((n, dim))) * rng.uniform(0.2, 3, n)[:, None]
    x[300:420] = x[300]                                     # a large group of copies
    out = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    out += [(n, None), (n + 20, [0.0] * dim), (n + 40, [None] * dim), (n + 60, [math.nan] + [1.0] * (dim - 1)), (n + 80, [math.inf] * dim),
            (n + 81, []), (None, out[7][1]), (40, out[40][1]), (n + 100, out[5][1][:4])]
    return out


def nearest(rows, every, k):
    dim = max(len(v) for _, v in rows if v)
    kept = [(i, np.array(v + [0.0] * (dim - len(v)))) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = sorted((-sum(float(s) * float(t) for s, t in zip(x, y)), math.inf if i is None else i, b) for b, (i, y) in enumerate(kept) if b != a)
            out += [(q, r + 1, None if i is math.inf else i, -s) for r, (s, i, _) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [dict(window=16, cell=16, chunk=12 * 40), dict(window=64, cell=8, chunk=12 * 1000), dict()])
def test_search_equals_brute_force(spark, sizes):
    data = vectors()
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, row string").repartition(5)
    got = sorted([tuple(r) for r in hilbert_search.search(table, F.col("vec_id") % 20 == 0, 20, **sizes).collect()], key=repr)
    want = nearest(data, 20, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want))


def test_search_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in hilbert_search.search(table, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]


def test_windows_alone_find_clustered_neighbours(spark):
    """The curves do the work where vectors have neighbours: recall of the windows without the exact check."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 32))[np.arange(8000) % 200] + 0.05 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hilbert_search.search(table, F.col("vec_id") % 100 == 0, 10, window=128, exact=False).groupBy("query_id").agg(F.collect_set("vec_id")).collect()
    s = x[::100] @ x.T
    s[np.arange(80), np.arange(0, 8000, 100)] = -2
    want = np.argsort(-s, axis=1)[:, :10]
    assert sum(len(set(found) & set(want[q // 100].tolist())) for q, found in got) / 800 >= 0.9


def test_search_matches_the_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    assert compare(hilbert_search.query(spark, SF_SMALL).toPandas(), con.sql(hilbert_search.SQL).df()) is None


# ---- tokenizer alignment ------------------------------------------------------

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a▁b c", "  two  spaces \n x  ", " ", "\n", "x", "<s> </s> <unk> <|endoftext|>", "tab\t tab", "nul\0 nul", "é́  à la carte 　 x y",
       "don't 've 'LL it's", "👍🏽" * 9 + " 𝔘𝔫", "a" * 700 + " " + "ab" * 300, " lead", "trail ", "1234567 89", "\x85 \x1c x", "⁇ ▁"]


def token_bytes():
    from retail_spark.llm.token_counts import byte_symbols

    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    spell = {i: (bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in range(sp.get_piece_size())}
    return (lambda s: [(i, b"".join(byte_of[c] for c in t.id_to_token(i))) for i in t.encode(" " + s, add_special_tokens=False).ids],
            lambda s: [(i, spell[i]) for i in sp.encode(s)])


def brute_alignment(texts):
    a_of, b_of = token_bytes()
    per, corpus = [], Counter()
    for s in texts:
        a, b = (a_of(s), b_of(s)) if s else ([], [])
        whole = (" " + s).encode() if s else b""
        if not s or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            per.append((0, 0, 0, "", Counter()))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = {e: ([], []) for e in shared}
        for k, side in enumerate((a, b)):
            at = 0
            for (i, _), e in zip(side, ends[k]):
                while shared[at] < e:
                    at += 1
                groups[shared[at]][k].append(str(i))
        links, x = Counter(), 0
        for (i, _), hi, lo in zip(a, ends[0], [0, *ends[0]]):
            while x and ends[1][x - 1] > lo:
                x -= 1
            while ends[1][x] <= lo:
                x += 1
            y = x
            while y < len(b) and (ends[1][y - 1] if y else 0) < hi:
                links[i, b[y][0]] += 1
                y += 1
        text = ";".join(",".join(p) + "|" + ",".join(q) for p, q in groups.values())
        per.append((len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest(), links))
        corpus.update(links)
    most = {}
    for (_, j), n in corpus.items():
        most[j] = max(most.get(j, 0), n)
    return [(*p[:3], sum(p[4].values()), sum(n for (i, j), n in p[4].items() if corpus[i, j] == most[j]), sum(n * corpus[k] for k, n in p[4].items()), p[3])
            for p in per]


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 50, 0])
def test_alignment_equals_brute_force(spark, edge_dir, edge_docs, hot_pairs, monkeypatch):
    texts = [(d[0], d[1]) for d in edge_docs] + [(10_000 + k, s) for k, s in enumerate(ODD)]
    monkeypatch.setattr(alignment, "MERGED", 1000)
    docs = spark.createDataFrame([(i, s, "x") for i, s in texts], "doc_id long, text string, pairs string").repartition(3)
    got = alignment.alignment(docs, A_PATH, B_PATH, hot_pairs=hot_pairs)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *r) for (i, _), r in zip(texts, brute_alignment([s for _, s in texts]))]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_alignment_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 100)
    own, again = alignment.Vocabularies(A_PATH, B_PATH), alignment.vocabularies(A_PATH, B_PATH)
    texts = [f"some words {k} and {k * 7} more" for k in range(50)]
    assert all(alignment.align(own, [s]).to_pylist() == alignment.align(again, [s]).to_pylist() for s in texts)
    assert len(own.known) < 50


# ---- filter audit -------------------------------------------------------------

def brute_audit(docs, labels):
    """docs (id, text, part); labels id -> (good, toxic).  Filters applied one after the other, order by order."""
    import re

    first = {}
    for i, s, _ in docs:
        if i is not None:
            first[s or ""] = min(first.get(s or "", i), i)
    rows = []
    for i, s, part in docs:
        s = s or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", s)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", s)) > 5 * len(s),
                 "D": bool(re.search("[#$%&*|]", s)), "E": i is not None and first[s] < i}
        rows.append((part or "", fails, *labels.get(i, (0, 0))))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                before = [r for r in own if r[1][f]]
                out.append([part, "".join(order), step, len(stay), len(gone), len(before) - len(gone),
                            sum(1 for r in before if sum(r[1].values()) == 1), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                shapley[part, f] += len(gone)
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("heavy", [filter_audit.HEAVY_SHARE, 4])
def test_audit_equals_brute_force(spark, heavy, monkeypatch):
    monkeypatch.setattr(filter_audit, "HEAVY_SHARE", heavy)
    many = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", "Short TEXT # here", many, many + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4, "the " * 80, many + " 100 %", "\x0b\x1c\x85 x", "é " * 70, "x" * 300_000]
    docs = [(i if i % 17 else None, texts[i * 7 % 10], [None, "", "s1", "s2"][i % 4]) for i in range(90)] + [(5, texts[5 * 7 % 10], "s1")] * 3
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 90, 2)] + [(4, 1, None), (4, 0, 0), (None, 1, 1)]
    known = {}
    for i, g, t in labels:
        known[i] = (max(known.get(i, (0, 0))[0], g == 1), max(known.get(i, (0, 0))[1], t == 1))
    known.pop(None)
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, source string, n long, mask string").repartition(4)
    got = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, known)


def test_audit_matches_the_sql_twin(spark, edge_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{edge_dir}/{t}.parquet'")
    assert compare(filter_audit.query(spark, edge_dir).toPandas(), con.sql(filter_audit.SQL).df()) is None
