"""Near-duplicates, neighbours, mixing, chat and the pipeline against brute force, on real and on awkward tables."""

import hashlib
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weekloom.llm import ann, chat, embed_dedup, graph, mixing, queries, simhash, vectors

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# ---- components ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (1, 2), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 900), (900, 17), (3, 4), (4, 8), (8, 3), (None, 2)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()}
    whole = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({n for e in whole for n in e}, whole)


def test_components_around_hubs(spark):
    """Nodes of far more edges than are dealt to one task: the least one, the largest one and one between."""
    edges = [(hub, n) for hub, some in ((0, range(1, 400)), (999, range(300, 700)), (500, range(690, 990))) for n in some] + [(2000, 2001)]
    edges = [edges[i] for i in np.random.default_rng(5).permutation(len(edges))]
    frame = spark.createDataFrame([*edges, *edges[:200]], "u bigint, v bigint").repartition(4)
    got = {r.node: r.component for r in graph.components(frame, hot_edges=16).collect()}
    assert got == brute_components({n for e in edges for n in e}, edges)


def test_components_of_a_random_graph(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (330, 2)) if e[0] != e[1]]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)).collect()}
    assert got == brute_components({n for e in edges for n in e}, edges)


# ---- SimHash ---------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "É", " ", "\n", "\x0b", "\x1c", "\xa0", "word", "  "]), max_size=40).map("".join))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_near(fps):
    ids = sorted(fps)
    return brute_components(ids, [(a, b) for a, b in combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])


def test_simhash_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    got = queries.QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_near(fps)


@pytest.mark.parametrize("heavy, tile", [(256, 1024), (4, 8)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, heavy, tile):
    """Groups that differ in few bits, in one half, the other, or both, and share segment values many times."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    fps = {0: 0, 1: 2**64 - 1}
    for centre in rng.integers(0, 2**64, 6, dtype=np.uint64).tolist():
        for _ in range(40):
            bits = rng.choice(64, rng.integers(0, 6), replace=False).tolist()
            fps[len(fps)] = centre ^ sum(1 << b for b in bits)
    fps = {i: f for f, i in {f: i for i, f in reversed(fps.items())}.items()}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    edges = simhash.links(spark.createDataFrame(rows, "node bigint, fp bigint"), 3)
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert {i: found.get(i, i) for i in fps} == brute_near(fps)
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 3 for r in simhash.links(spark.createDataFrame(rows, "node bigint, fp bigint"), 3).collect()) or heavy < 256


def test_light_values_beside_crowded_ones_are_dealt_out(spark, monkeypatch):
    """A value that one fingerprint has, in reach of a value that 300 have: its probes must not meet in one task."""
    monkeypatch.setattr(simhash, "HEAVY", 64)
    crowd, lone = 0b1000 << 32, 0b1001 << 32
    rows = [(i, crowd | i) for i in range(300)] + [(900, lone | 5), (901, 7 << 40)]
    seg_key = spark.createDataFrame([(1, f >> 32, i, f) for i, f in rows] + [(0, f & 0xFFFFFFFF, i, f) for i, f in rows], "seg int, key bigint, node bigint, fp bigint")
    heavy = {(r.seg, r.key) for r in simhash._crowded(seg_key).collect()}
    assert {(1, crowd >> 32), (1, lone >> 32)} <= heavy and (1, 7 << 8) not in heavy
    found = {r.node: r.component for r in graph.components(simhash.links(spark.createDataFrame(rows, "node bigint, fp bigint"))).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute_near(dict(rows))


def test_very_many_copies_and_clashing_columns(spark):
    """10^5 equal rows with ids, and as many without."""
    copies = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("one page that is copied").alias("text"))
    df = copies.unionByName(spark.createDataFrame([(5, "some other text of its own"), (5, "and one that repeats its id")], "doc_id bigint, text string"))
    for name in ("_fp", "row", "fp", "n", "component_id", "_salt"):
        df = df.withColumn(name, F.lit(7))
    got = simhash.simhash_components(df).groupBy("component_id").count().collect()
    assert sorted((r.component_id, r["count"]) for r in got) == [(0, 100_000), (5, 2)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 5]
    assert {r._fp for r in kept.collect()} == {7}


def test_simhash_of_awkward_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "some words that are here"), (7, "some words that are here"), (2, "some words that are here"), (None, "some words that are here"), (None, "alone without any id"), (None, "alone without any id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x"))
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 2), (2, 2), (3, 3), (5, 3), (7, 2), (7, 2), (9, 3)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3]
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# ---- neighbours --------------------------------------------------------------------------------------------------------


def test_cleaning_of_vectors(spark):
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [0.0, -0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (8, [-0.0, 3.0], None)]
    got = {r.vec_id: (r.label, r.dim, np.frombuffer(r.vec).tolist()) for r in vectors.clean(spark.createDataFrame(rows, VECTORS), "label").collect()}
    assert got == {1: ("1", 2, [1.0, 2.0]), 8: (None, 2, [0.0, 3.0])}


def brute_nearest(rows, queries_, k):
    out = []
    for q in queries_:
        x = rows[q]
        scored = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in rows.items() if i != q and len(y) == len(x))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [(2048, 2048, 8192), (3, 5, 40)])
def test_nearest_is_exact(spark, sizes):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=8).astype(np.float32).astype(float) for i in range(300)}
    rows |= {i: rows[0] for i in range(300, 420)}  # one vector very many times
    rows |= {500: np.array([1.0, 2.0]), 520: np.array([2.0, 1.0])}
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in rows.items()] + [(7, rows[7].tolist(), 1), (540, None, 1), (560, [0.0] * 8, 1)], VECTORS).repartition(4)
    got = ann.nearest(df.filter("vec_id % 20 = 0"), df, 10, *sizes)
    assert sorted(map(tuple, got.collect())) == sorted(brute_nearest(rows, [i for i in rows if i % 20 == 0], 10))
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_nearest_with_rows_that_repeat(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).astype(np.float32).astype(float) for i in range(400)}
    best = brute_nearest(rows, [0], 1)[0][2]
    table = [(i, x.tolist(), 1) for i, x in rows.items()] + [(best, rows[best].tolist(), 1)] * 30
    table += [(20, None, 1)] * 8 + [(40, [*rows[40].tolist(), 1.0], 1)] * 3
    df = spark.createDataFrame(table, VECTORS).repartition(4)
    got = ann.nearest(df.filter("vec_id % 20 = 0"), df, 10).collect()
    assert sorted(map(tuple, got)) == sorted(brute_nearest(rows, [i for i in rows if i % 20 == 0], 10))


def test_a_query_whose_first_row_is_unusable(spark):
    df = spark.createDataFrame([(0, None, 1), (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], VECTORS).coalesce(1)
    assert [tuple(r) for r in ann.nearest(df.filter("vec_id = 0"), df).collect()] == [(0, 1, 1, 1.0)]


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 10
    (qx, sx, rx), (qy, sy, ry) = ann.quantised(x), ann.quantised(y)
    near, norm = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy, lambda v: np.linalg.norm(v, axis=1)
    assert (np.abs(near - x @ y.T) <= norm(x)[:, None] * norm(ry) + norm(rx)[:, None] * norm(y) + norm(rx)[:, None] * norm(ry) + 1e-9).all()


@pytest.mark.parametrize("copies", [25, 3000])
@pytest.mark.parametrize("strip", [8192, 300])
def test_nearest_among_many_copies(spark, copies, strip):
    """One vector near the query, once under one id very many times and once under very many ids; and near copies."""
    rng = np.random.default_rng(7)
    rows = {i: rng.normal(size=8).astype(np.float32).astype(float) for i in range(400)}
    rows |= {1000 + i: (rows[0] * 1.5).astype(np.float32).astype(float) for i in range(copies)}
    rows |= {9000 + i: (rows[20] + rng.normal(size=8) * 1e-3).astype(np.float32).astype(float) for i in range(300)}
    best = brute_nearest(rows, [40], 1)[0][2]
    table = [(i, x.tolist(), 1) for i, x in rows.items()] + [(best, rows[best].tolist(), 1)] * copies
    df = spark.createDataFrame(table, VECTORS).repartition(4)
    wanted = [i for i in rows if i < 400 and i % 20 == 0]
    got = ann.nearest(df.filter("vec_id < 400 and vec_id % 20 = 0"), df, 20, strip=strip).collect()
    assert sorted(map(tuple, got)) == sorted(brute_nearest(rows, wanted, 20))


def test_join_with_a_hot_key(spark, monkeypatch):
    from weekloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    many = common.settle(spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k bigint, v bigint"))
    one = spark.createDataFrame([(i, i * 2) for i in range(0, 900, 2)], "k bigint, w bigint")
    for how in ("inner", "left"):
        got = common.spread_join(many, one, ["k"], how)
        assert sorted(map(repr, got.select("k", "v", "w").collect())) == sorted(map(repr, many.join(one, "k", how).select("k", "v", "w").collect()))


def brute_links(rows, least=0.93):
    links = defaultdict(set)
    for (a, (x, p)), (b, (y, q)) in combinations(rows.items(), 2):
        if p is not None and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            links[a].add(b)
            links[b].add(a)
    return links


@pytest.mark.parametrize("tile, most_cells", [(1024, 1024), (7, 1024), (1024, 3), (7, 2)])
def test_near_vectors(spark, monkeypatch, tile, most_cells):
    """With one level of cells, and with two."""
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    monkeypatch.setattr(embed_dedup, "CELL", 10)
    monkeypatch.setattr(embed_dedup, "MOST_CELLS", most_cells)
    monkeypatch.setattr(embed_dedup, "CHUNK", 50)
    rng = np.random.default_rng(4)
    rows = {}
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12)) if g else 60):
            rows[len(rows)] = ((centre + rng.normal(size=16) * rng.choice([0.02, 0.15])).astype(np.float32).astype(float), g % 3)
    for copy in range(30):
        rows[len(rows)] = rows[0]
    rows[len(rows)] = (rows[0][0] * 2, None)
    table = [(i, x.tolist(), p) for i, (x, p) in rows.items()] + [(0, rows[0][0].tolist(), 0), (900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(table, VECTORS).withColumn("cell", F.lit(9)).repartition(3)
    got = embed_dedup.near_duplicates(df).collect()
    links = brute_links(rows)
    label = brute_components(list(rows), [(a, b) for a, some in links.items() for b in some])
    assert len(got) == len(table)
    for r in got:
        if r.vec_id in rows:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), label[r.vec_id], label[r.vec_id] == r.vec_id)
        elif r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims, power, most_cells", [(64, 2, 1024), (64, 0, 1024), (16, 0, 1024), (4, 0, 1024), (64, 0, 5), (16, 1, 6), (4, 0, 8)])
def test_default_margin_loses_no_link(spark, monkeypatch, dims, power, most_cells):
    """Borderline pairs across many cells, also where few directions carry most of the vectors, at one level and at two."""
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    monkeypatch.setattr(embed_dedup, "MOST_CELLS", most_cells)
    rng, scale = np.random.default_rng(8), 1 / np.arange(1, dims + 1) ** power
    x, d = (rng.normal(size=(600, dims)) * scale for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    rows = np.concatenate([x, y])
    links = (rows @ rows.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()} == dict(enumerate(links.tolist()))


# ---- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)


def mixed_by_source(df):
    got = mixing.mix(df).collect()
    return got, df.select("doc_id", "source").collect()


def test_mixing_targets_and_words(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.source for r in df.collect()}
    words = {r.doc_id: len((r.text or "").encode().split()) for r in df.collect()}
    sizes = defaultdict(int)
    for i, n in words.items():
        sizes[source[i]] += n
    want, taken = brute_targets(sizes), defaultdict(int)
    got = queries.QUERIES["op3_source_mixing"](spark, sf_dir).collect()
    assert len(got) == len(words)
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (0, r.size, 2 * r.size) and 0 < r.rate <= 2
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60)
    again = queries.QUERIES["op3_source_mixing"](spark, sf_dir)
    assert sorted(again.collect()) == sorted(got)


def test_mixing_does_not_depend_on_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted((r.doc_id, r.copies) for r in mixing.mix(x).collect()) for x in (df, df.repartition(7, "n_chars")))
    assert a == b


def test_rates_are_one_exponential_tilt_for_each_source(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = defaultdict(list)
    for r in mixing.mix(df).filter("rate < 2 and size > 0").collect():
        by[r.target, r.source_size].append(np.log(r.rate) / r.size)
    for some in by.values():
        assert np.allclose(some, some[0], rtol=1e-6)


def test_mixing_of_awkward_tables(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "w " * 40, None), (4, "one", "tiny"), (5, "long " * 3000, "é"), (6, "x " * 10, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(-1)).withColumn("target", F.lit(0))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.copies * r.size <= 2 * r.size for r in got)
    assert sum(r.copies for r in got if r.size == 0) == 0
    made = mixing.mixed(df)
    assert made.columns == df.columns and made.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).collect()[0].copies == 0


def test_mixing_of_rows_that_repeat(spark):
    """Null ids, one id and one row very many times take about as long as distinct ids, and meet the targets."""
    text = F.concat(F.lit("some words "), F.expr("repeat('x ', cast(id % 5 as int))"))
    n, times = 20_000, {}
    for name, doc_id in (("distinct", F.col("id")), ("null", F.lit(None).cast("long")), ("one", F.lit(3).cast("long"))):
        df = spark.range(n).select(doc_id.alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
        for column in ("_row", "_copies", "_fp", "_score", "row", "total", "h", "times", "copies", "nth"):
            df = df.withColumn(column, F.lit(7))
        began = time.time()
        got = mixing.mix(df).groupBy("source_size").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
        times[name] = time.time() - began
        assert sum(r.n for r in got) == n and all(abs(r.taken - r.target) <= 0.01 * r.target and r.most <= 2 for r in got)
        made = mixing.mixed(df)
        assert made.columns == df.columns and made.filter("_row <> 7 or _copies <> 7 or row <> 7 or h <> 7").count() == 0
        words = made.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
        assert words == sum(r.taken for r in got)
    assert max(times.values()) <= 3 * times["distinct"] + 2


def test_a_target_that_is_not_met_is_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    with pytest.warns(UserWarning, match="off their target"):
        mixing.mix(df)


def test_ranks_over_ranges(spark):
    from weekloom.llm import common

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 2 == 0).alias("b")).repartition(7)
    want = {(r.b, r.k): i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.b, r.k)), 1)}
    assert {(r.b, r.k): r.n for r in common.ranked(df, ["b", "k"], "n").collect()} == want
    assert common.repeated(spark.createDataFrame([(1, 3), (2, 0), (3, 25)], "a int, t bigint"), "t", 10).groupBy("a").count().orderBy("a").collect() == [(1, 3), (3, 25)]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé￿😀", min_size=1, max_size=3)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets_against_repeated_sharing(spark, sizes):
    if not sum(sizes.values()):
        return
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size bigint")
    got = {None if r.no_source else r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(want[s], abs=1e-6) for s in sizes}


def test_mixing_plan_has_no_python(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


# ---- chat --------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|end|>"]), st.lists(st.sampled_from(["<|turn|>", "<|end|>", "\n", "\\", "<", "|", ">", "[INST]", "[/INST]", "</s>", "<<SYS>>", "é", "n", "<|im_start|>"]), max_size=12).map("".join)), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    roles, texts = map(list, zip(*turns))
    buffer, rows, starts, ends = chat.assemble([chat.escape_role(r).encode() for r in roles], [chat.escape(t).encode() for t in texts], np.array([len(turns)]))
    data = buffer.tobytes()
    assert rows.tolist() == [0, len(data)]
    assert chat.read_turns(data.decode()) == turns
    for text, a, b in zip(texts, starts, ends):
        inner = data[a:b].decode()
        assert chat.unescape(inner) == text
        assert not any(c in inner for c in ("<|turn|>", "<|end|>", "[INST]", "</s>", "<<SYS>>", "<|im_start|>"))


def brute_chat(turns):
    out = {}
    for conv, some in turns.items():
        said = "".join(t for r, t in some if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(some), sha("".join(f"{r}\n{t}\n" for r, t in some)), len(said), sha(said))
    return out


def chat_batches(rows, monkeypatch, **limits):
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(chat, name, value)
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["conv_id", "role", "text"])
    return list(chat._format(iter([table])))


def test_chat_batches_keep_to_their_bytes(monkeypatch):
    """Formatted bytes count: escapes double these texts, and one turn is longer than all limits."""
    rows = [(i // 3, "assistant" if i % 3 else "user", "\\é|>" * (i * 7 % 40)) for i in range(90)] + [(99, "assistant", "\\" * 5000), (None, "user", "x")]
    made = chat_batches(rows, monkeypatch, PART_BYTES=700, BATCH_BYTES=1500, SCATTER_BYTES=64)
    assert len(made) > 5
    for batch in made:
        assert len("".join(batch.column("formatted").to_pylist()).encode()) <= 1500 or batch.num_rows == 1
    turns, loss = defaultdict(list), defaultdict(str)
    for batch in made:
        for conv, part, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_starts", "loss_ends"))):
            turns[conv] += chat.read_turns(formatted)
            loss[conv] += "".join(chat.unescape(formatted.encode()[a:b].decode()) for a, b in zip(starts, ends))
    want = defaultdict(list)
    for conv, role, text in rows:
        want[conv].append((role, text))
    assert turns == want and loss == {c: "".join(t for r, t in some if r == "assistant") for c, some in want.items()}


def test_a_turn_too_long_for_a_string_is_an_error(monkeypatch):
    with pytest.raises(ValueError, match="conversation 7"):
        chat_batches([(7, "user", "x" * 100)], monkeypatch, MOST_BYTES=90)


@pytest.mark.parametrize("turns_a_part", [4096, 2])
def test_chat_of_awkward_rows(spark, monkeypatch, turns_a_part):
    monkeypatch.setattr(chat, "PART_TURNS", turns_a_part)
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "b</s>"), (2, None, None, "x"), (2, 0, "assistant", ""), (None, 3, "user", "q"), *((3, i, "assistant" if i % 2 else "user", f"t{i}é") for i in range(50))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("x")).repartition(3)
    parts = chat.format_chat(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    turns = {1: [("user", ""), ("assistant", "b</s>"), ("assistant", "b</s>")], 2: [("", "x"), ("assistant", "")], None: [("user", "q")], 3: [("assistant" if i % 2 else "user", f"t{i}é") for i in range(50)]}
    assert got == brute_chat(turns)
    whole = defaultdict(str)
    for r in parts.orderBy("part").collect():
        whole[r.conv_id] += r.formatted
    assert {c: chat.read_turns(t) for c, t in whole.items()} == turns
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("ident", [None, 5])
def test_a_hot_conversation_is_dealt_over_tasks(spark, monkeypatch, ident):
    """Half of all turns have one id or none; ties of turn, role and a long common beginning, repeated rows and null turns."""
    monkeypatch.setattr(chat, "PART_TURNS", 50)
    hot = [(ident, None if i % 97 == 0 else i // 3, "assistant" if i % 2 else None, ("same " * 20 if i % 4 else "") + f"x{i % 500} </s>") for i in range(6000)]
    others = [(i // 4 + 100, i % 4, "assistant" if i % 2 else "user", f"t{i} é") for i in range(4000)]
    df = spark.createDataFrame(hot + others, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    parts = chat.format_chat(df)
    cut = parts.filter("is_cut").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # few bytes would go to one task
    by_task = [(r["count"], r.least, r.most) for r in cut.groupBy("task").agg(F.count("*").alias("count"), F.min("n_turns").alias("least"), F.max("n_turns").alias("most")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_task) >= 3 and sum(n for n, *_ in by_task) == 120 and {x for _, *some in by_task for x in some} == {50}
    places = [r.part for r in cut.orderBy("part").collect()]
    assert places == list(range(0, 6000, 50))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    first = lambda x: (x is not None, x or 0)
    want = defaultdict(list)
    for c, t, r, x in sorted(hot + others, key=lambda row: (first(row[1]), row[2] is not None, row[2] or "", row[3].encode())):
        want[c].append((r or "", x))
    assert got == brute_chat(want)


def test_few_turns_are_formatted_once_and_without_ranges(spark, sf_dir):
    plan = queries.QUERIES["op5_chat_formatting"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_format(") == 1 and "RepartitionByExpression [conv_id" in plan


# ---- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions are those of its operator on what the stage before kept."""
    from weekloom.llm import langid, secret_scan, spm_codec

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = [f.simpleString() for f in docs.schema.fields]
    made = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made.append(stage(spark, made[-1], sf_dir).cache())
        assert [f.simpleString() for f in made[-1].schema.fields] == kinds
    first, told, kept, masked, mixed = ([(r.doc_id, r.text, r.source, r.n_chars) for r in m.collect()] for m in made)
    predictions = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs).collect()}
    assert sorted(told) == sorted(r for r in first if predictions[r[0]][0] != "und" and predictions[r[0]][1] >= 0.3)
    near = brute_near({i: simhash.fingerprint((t or "").encode()) for i, t, *_ in told})
    assert sorted(kept) == sorted(r for r in told if near[r[0]] == r[0])
    for (i, t, *_), (j, m, _, n) in zip(sorted(kept), sorted(masked)):
        assert i == j and m == secret_scan.redact(t, secret_scan.scan_text(t)) and n == len(m)
    copies = {r.doc_id: r.copies for r in mixing.mix(made[3]).collect()}
    assert sorted(mixed) == sorted(r for r in masked for _ in range(copies[r[0]]))
    last = corpus_pipeline.STAGES[-1][1](spark, made[4], sf_dir).collect()
    own = spm_codec.codec()
    text = {i: t for i, t, *_ in mixed}
    assert len(last) == len(mixed)
    for r in last[:40]:
        assert r.ids == own.processor.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))
    for m in made[1:]:
        m.unpersist()


def test_pipeline_of_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_queries_with_sql_agree(spark, sf_dir):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        mine, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).values.tolist()))
        assert rows(mine) == rows(theirs), name


def test_placing_in_many_cells_takes_bounded_memory():
    """1024 cells at 768 dimensions: what placing allocates stays far below cells x cells x dimensions."""
    import tracemalloc

    rng = np.random.default_rng(3)
    centres, x = embed_dedup.unit(rng.normal(0, 1, (1024, 768))), rng.normal(0, 1, (3000, 768))
    tracemalloc.start()
    home, visits = embed_dedup._places(x, centres, embed_dedup.apart(centres), embed_dedup.exact_margin(0.93))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    far = np.linalg.norm(centres[:40, None] - centres[None, :40], axis=2)
    assert (embed_dedup.apart(centres)[:40, :40] >= far - 1e-12).all() and np.allclose(embed_dedup.apart(centres)[:40, :40], far, atol=1e-5)
    assert (home == (embed_dedup.unit(x) @ centres.T).argmax(axis=1)).all() and all(h in v for h, v in zip(home, visits))


def test_centroids_of_wide_vectors_are_fitted_on_fewer(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SAMPLE_BYTES", 50 * 8 * 16)
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    taken = vectors.clean(rows).filter(embed_dedup._some(F.lit(1000), embed_dedup._sampled(F.col("dim")))).count()
    assert 25 <= taken <= 90


@pytest.mark.parametrize("most", [0, 100_000])
def test_hot_vec_ids_keep_their_rows(spark, monkeypatch, most):
    from weekloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(common, "MOST_TILED", most)
    rows = [(7, [1.0, 0.0], 1)] * 40 + [(None, [1.0, 0.0], 1)] * 30 + [(9, [1.0, 0.01], 1), (8, None, 1)]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == sorted([(7, 1, 7, True)] * 40 + [(None, 0, None, None)] * 30 + [(9, 1, 7, False), (8, 0, 8, True)], key=str)


@pytest.mark.parametrize("most,crowd", [(ann.MOST_PAIRS, ann.CROWD), (ann.MOST_PAIRS, 20), (3000, 100_000), (1, 1)])
def test_neighbours_in_a_crowd_of_near_copies(spark, most, crowd):
    """Candidates whose bounds overlap: exact, whether pairs are held, given up for their number, or for one query's."""
    rng = np.random.default_rng(12)
    centre = rng.normal(0, 1, 16)
    x = np.vstack([centre + 1e-9 * rng.normal(0, 1, (700, 16)), rng.normal(0, 1, (200, 16)), np.tile(centre, (60, 1))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(5)
    got = ann.nearest(rows.filter("vec_id % 20 = 0"), rows, k=7, block=16, tile=64, strip=200, most=most, crowd=crowd).collect()
    want = []
    for q in range(0, len(x), 20):
        scores = ann.exact(np.tile(x[q], (len(x), 1)), x)
        order = [v for v in np.lexsort((np.arange(len(x)), -scores)).tolist() if v != q][:7]
        want += [(q, r, v, float(scores[v])) for r, v in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_block_holds_no_more_pairs_than_it_may():
    """Nothing can be pruned among 30 000 candidates of 256 queries, and yet memory stays where it is."""
    import tracemalloc

    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, 32)
    near = lambda n: centre + 1e-9 * rng.normal(0, 1, (n, 32))

    def coded(x, first):
        batch = __import__("pyarrow").RecordBatch.from_pydict({"dim": np.full(len(x), 32, np.int32), "vec_id": np.arange(first, first + len(x)), "vec": [v.tobytes() for v in x]})
        (out,) = ann._coded([batch])
        return ann.Coded(out)

    block = ann.Block(coded(near(256), 0), 20, 1 << 16, ann.CROWD)
    tiles = [coded(near(2000), 1000 + 2000 * k) for k in range(15)]
    tracemalloc.start()
    for tile in tiles:
        block.add(tile)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block.held <= 1 << 16 and most < 200 << 20
    out = block.batch()
    assert out.column("vec_id").null_count == 256
