import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.kernel import SketchParams, sampled_keys
from kmerloom.functions.scalars import safe_name
from kmerloom.operators import ani, composite, distance, legacy, reports, setops, sketching
from kmerloom.operators import training
from kmerloom.operators.skew import hot_left_join, with_sum_before


def keyed(spark, data):
    return spark.createDataFrame([(g, k, c) for g, ks in data.items() for k, c in ks.items()], "genome_id long, ctxobj long, cnt long")


def random_sets(seed, genomes=12, universe=60):
    rnd = random.Random(seed)
    return {g: {rnd.randrange(universe) - 20: rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 50))} for g in range(genomes)}


def test_sketch_counts_and_conflicts(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(500))
    changed = base[:250] + ("A" if base[250] != "A" else "C") + base[251:]
    p = SketchParams(half_context=4, outer=2, fold=0)
    records = spark.createDataFrame([(1, base, "x"), (1, changed, "x"), (2, base, "x"), (3, None, "x"), (None, base, "x"), (4, "ACG", "x")], "genome_id int, seq string, cnt string")
    got = {}
    for r in sketching.sketch(records, p).collect():
        got.setdefault(r.genome_id, {})[r.ctxobj] = r.cnt
    for g, seqs in ((1, [base, changed]), (2, [base])):
        counts = Counter(k - (1 << 64) if k >> 63 else k for k in sampled_keys(seqs, p)[1].tolist())
        contexts = Counter(k >> p.object_bits for k in counts)
        assert got[g] == {k: n for k, n in counts.items() if contexts[k >> p.object_bits] == 1}
    assert set(got) == {1, 2}
    twice = sketching.sketch(records, SketchParams(half_context=4, outer=2, fold=0, least_count=2, keep_conflicts=True)).where("genome_id = 1")
    assert twice.agg({"cnt": "min"}).first()[0] >= 2
    by_record = sketching.sketch_by_record(records.selectExpr("monotonically_increasing_id() AS rec", "seq"), p, "rec")
    assert by_record.select("genome_id").distinct().count() == 4


def test_merge_needs_equal_parameters(spark):
    a = keyed(spark, {0: {1: 1}, 1: {2: 1}})
    out = sketching.merge((a, 2, SketchParams()), (a, 2, SketchParams()))
    assert sorted(r.genome_id for r in out.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        sketching.merge((a, 2, SketchParams()), (a, 2, SketchParams(fold=3)))


def test_set_algebra(spark):
    data = random_sets(1)
    keys = keyed(spark, data)
    df = Counter(k for ks in data.values() for k in ks)
    assert {r[0] for r in setops.union(keys).collect()} == set(df)
    assert {r[0] for r in setops.unique_union(keys).collect()} == {k for k, n in df.items() if n == 1}
    assert {tuple(r) for r in setops.markers(keys).collect()} == {(g, k) for g, ks in data.items() for k in ks if df[k] == 1}
    pan = setops.union(keys.where("genome_id < 3"))
    inside, outside = setops.intersect(keys, pan), setops.subtract(keys, pan)
    assert sorted(map(tuple, inside.unionByName(outside).select("genome_id", "ctxobj").collect())) == sorted((g, k) for g, ks in data.items() for k in ks)
    assert inside.join(outside, ["genome_id", "ctxobj"]).count() == 0
    groups = spark.createDataFrame([(0, 5, "a"), (1, 5, "a"), (2, 0, None), (3, None, None), (4, 7, "b")], "genome_id long, taxid int, taxname string")
    got = {tuple(r) for r in setops.group_union(keys, groups).collect()}
    assert got == {(5, k) for g in (0, 1) for k in data[g]} | {(7, k) for k in data[4]}
    assert setops.checked_groups(groups).count() == 3
    with pytest.raises(ValueError):
        setops.checked_groups(groups.unionByName(spark.createDataFrame([(9, 5, "c")], groups.schema)))
    assert setops.combine(pan, pan).select("genome_id").distinct().count() == 2
    sizes = setops.sizes(keys, spark.createDataFrame([(0, "x"), (99, "y"), (99, "y")], "genome_id long, name string"))
    assert {r.genome_id: r.size for r in sizes.collect()} == {0: len(data[0]), 99: 0}


def test_overlaps_and_distances(spark):
    data = random_sets(2)
    keys = keyed(spark, data)
    pairs = distance.sized_overlaps(keys, keys)
    got = {(r.q, r.r): r for r in distance.sampled_distance(distance.similarities(pairs, 21), 21).collect()}
    want = {(a, b): len(data[a].keys() & data[b].keys()) for a in data for b in data}
    assert {k: r.shared for k, r in got.items()} == {k: n for k, n in want.items() if n}
    for (a, b), r in got.items():
        j = r.shared / len(data[a].keys() | data[b].keys())
        assert math.isclose(r.jaccard, j) and math.isclose(r.mash, -math.log(2 * j / (1 + j)) / 21, abs_tol=1e-12)
        assert math.isclose(r.dist, r.mash, abs_tol=1e-12)
        assert math.isclose(r.containment, r.shared / min(len(data[a]), len(data[b])))
    p = distance.with_p_values(distance.sampled_distance(pairs, 21), 144).collect()
    assert all(0 <= r.p <= 0.5 and math.isclose(r.q_value, r.p * 144) for r in p)
    near = distance.nearest(distance.similarities(pairs, 21), "jaccard", 3).collect()
    assert all(n <= 3 for n in Counter(r.q for r in near).values())
    assert {(r.q, r.r) for r in near if r.place == 1} == {(g, g) for g in data}
    full = distance.full_matrix(distance.similarities(pairs, 21), keys, keys, "mash")
    assert full.count() == 144
    assert distance.wide_matrix(full, [0, 1]).columns == ["q", "0", "1"]
    triangle = full.where("r < q")
    assert distance.symmetric(triangle).count() == 144
    limited = distance.sampled_distance(pairs, 21, containment="min", limit=0.01)
    assert limited.where("dist > 0.01").count() == 0


def test_dereplication_is_the_greedy_choice(spark):
    rnd = random.Random(9)
    dists = {(a, b): rnd.random() for a in range(40) for b in range(a) if rnd.random() < 0.3}
    kept = []
    for g in range(40):
        if all(dists.get((g, k), 1) >= 0.4 for k in kept):
            kept.append(g)
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in dists.items()], "q long, r long, mash double")
    genomes = spark.createDataFrame([(g, f"g{g}") for g in range(40)], "genome_id long, name string")
    chosen = distance.dereplicate(pairs, genomes, 0.4)
    assert sorted(r.genome_id for r in chosen.where("kept").collect()) == kept and chosen.count() == 40
    codes = {r.genome_id: r.code for r in distance.selection_codes(chosen, genomes).collect()}
    assert codes == {g: f"{kept.index(g) + 1}\tg{g}" if g in kept else f"0\tNULL\tg{g}" for g in range(40)}


def test_ani_features(spark):
    rnd = random.Random(4)
    rows = {(rnd.randrange(6), rnd.randrange(15), rnd.randrange(64)) for _ in range(200)}
    index = spark.createDataFrame(sorted(rows), "genome_id long, ctx long, obj long")
    got = {(r.q, r.r): tuple(r)[2:] for r in ani.features(index, index).collect()}
    bases = lambda x: sum((x >> 2 * i & 3) > 0 for i in range(32))
    want = {}
    for q in range(6):
        for r, ctx, obj in rows:
            mine = [o for g, c, o in rows if g == q and c == ctx]
            if mine:
                d = min(bases(o ^ obj) for o in mine)
                f = want.setdefault((q, r), [0, 0, 0, 0])
                f[0] += 1
                f[1] += d > 0
                f[2] += d
                f[3] += d > 1
    assert got == {k: tuple(v) for k, v in want.items()}
    table = ani.ranked(ani.ani_table(index, index, least_fraction=0.0, least_ani=0.0))
    assert table.where("place = 1").count() == 6
    assert {r.ani for r in table.where("q = r and n_diff_obj = 0").collect()} <= {1.0}
    with pytest.raises(ValueError):
        ani.ani_table(index, index, metric="none")


@pytest.mark.parametrize("m", [5, 6, 7, 99, 100, 101, 200])
def test_composition_order_statistics(spark, m):
    rnd = random.Random(m)
    counts = {k: rnd.randrange(1, 30) for k in range(m)}
    sample, ref = keyed(spark, {1: counts | {10**6: 50}}), keyed(spark, {7: dict.fromkeys(range(m), 1)})
    got = composite.composition(sample, ref).collect()
    a = sorted(counts.values())
    if m < 6:
        assert not got
        return
    first, upper, n = int(m * 0.98), 0, int(m * 0.99 - int(m * 0.98) + 1)
    while first < m * 0.99:
        upper += a[first]
        first += 1
    r = got[0]
    assert (r.shared, r["median"], r["max"]) == (m, a[m // 2], a[-1])
    assert math.isclose(r["mean"], sum(a) / m) and math.isclose(r.pct98_99, upper / n)


def test_vector_search(spark):
    v = {"s": {1: 60.0, 2: 40.0}, "t": {1: 10.0, 3: 90.0}, "u": {9: 100.0}}
    df = spark.createDataFrame([(s, i, x) for s, d in v.items() for i, x in d.items()], "sample string, ref_idx long, pct double")
    get = lambda m: {(r.q, r["sample"]): r.measure for r in composite.search_vectors(df, df, m).collect()}
    assert get("l1")["s", "t"] == 180.0 and get("l1")["s", "s"] == 0 and ("s", "u") not in get("l1")
    assert get("l2")["s", "t"] == 50.0
    assert math.isclose(get("cosine")["s", "t"], 600 / math.hypot(60, 40) / math.hypot(10, 90))


def test_legacy(spark):
    seq = "".join(random.Random(5).choices("ACGT", k=400))
    records = spark.createDataFrame([(1, seq, "I" * 400), (2, seq[::-1].translate(str.maketrans("ACGT", "TGCA")), "I" * 400), (3, None, None)], "genome_id long, seq string, qual string")
    all_keys = legacy.legacy_keys(records, 6, 3, 0, seed=1)
    by = {g: {r.key: r.cnt for r in all_keys.where(f"genome_id = {g}").collect()} for g in (1, 2, 3)}
    assert by[1] == by[2] and sum(by[1].values()) == 400 - 11 and not by[3]
    kmers = {r.kmer for r in legacy.legacy_kmer(all_keys, 6).collect()}
    assert all(k in seq or k[::-1].translate(str.maketrans("ACGT", "TGCA")) in seq for k in kmers)
    fewer = legacy.legacy_keys(records, 6, 4, 1, seed=1)
    assert 0 < fewer.count() < all_keys.count()
    assert legacy.legacy_keys(records, 6, 3, 0, 1, quality="qual", least_quality=50).count() == 0
    assert legacy.posting_lists(all_keys).where("size(genomes) = 2").count() == len(by[1])
    assert legacy.permutation_table(spark, 2, 3).count() == 256
    shared = {(r.q, r.r): r for r in legacy.mean_shared_abundance(all_keys, all_keys).collect()}
    assert shared[1, 2].shared == len(by[1]) and math.isclose(shared[1, 2].mean_cnt, sum(by[1].values()) / len(by[1]))
    assert legacy.once_only(all_keys).where("cnt > 1").count() == 0


def test_hot_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(30)], "key long, name string")
    want = sorted((k, v, f"r{k}" if k is not None and k < 30 else None) for k, v in [(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 1)] if k is not None)
    for rows, salts, least in ((None, 0, 0), (539, 0, 0), (None, 4, 0), (539, 0, 10_000)):
        got = [tuple(r) for r in hot_left_join(left, right, "k", "key", rows, hot_share=0.1, salts=salts, hot_rows=least).collect()]
        assert sorted(x for x in got if x[0] is not None) == want and (None, 1, None) in got


def test_reports(spark):
    rows = spark.createDataFrame([("s", "d__A;p__B; s__C1", 1.0), ("s", "d__A;p__B", 2.0), ("s", None, 4.0), ("t", "d__A", 8.0)], "sample string, line string, v double")
    want = {("s", "domain", "d__A"): 3.0, ("s", "phylum", "d__A|p__B"): 3.0, ("s", "species", "d__A|p__B|s__C1"): 1.0, ("t", "domain", "d__A"): 8.0}
    assert {(r["sample"], r["rank"], r.path): r.value for r in reports.lineage_profile(rows, "sample", "line", "v").collect()} == want
    krona = {(r["sample"], r.taxonomy): r.percentage for r in reports.krona_rows(rows.where("line is not null"), "sample", "line", "v").collect()}
    assert krona == {("s", "A\tB\tC1"): 33.3333, ("s", "A\tB"): 66.6667, ("t", "A"): 100.0}
    assert [r[0] for r in rows.select(reports.species_of(rows.line)).collect()] == ["C1", None, None, None]
    nodes = spark.createDataFrame([(1, None, "superkingdom"), (2, 1, "genus"), (3, 2, "species"), (4, 2, "species")], "node long, parent long, rank string")
    found = spark.createDataFrame([("s", 3, 10.0), ("s", 4, 5.0), ("s", 99, 1.0)], "sample string, taxid long, percentage double")
    assert {(r["rank"], r.taxid): r.value for r in reports.roll_up(found, nodes).collect()} == {("superkingdom", 1): 15.0, ("genus", 2): 15.0, ("species", 3): 10.0, ("species", 4): 5.0}
    meta = spark.createDataFrame([("a", "x"), ("a", "y")], "run string, info string")
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run string, n int")
    assert sorted(map(tuple, reports.with_metadata(runs, meta, "run").collect())) == [("a", 1, "x"), ("b", 2, "NA")]
    assert reports.subset(runs, meta, "run").count() == 1
    assert [r.info for r in reports.ordered_subset(runs, "n", meta, "run", "info").collect()] == ["x", "==no match=="]
    jplace = '{"fields": ["like", "edge_num"], "placements": [{"n": ["r1", "also"], "p": [[0.5, 7], [0.4, 8]]}]}'
    assert sorted(map(tuple, reports.placements(spark.createDataFrame([(jplace,)], "t string"), "t").collect())) == [("r1", 7), ("r1", 8)]
    counts = keyed(spark, {0: {1: 1, 2: 2, 3: 1}, 1: {3: 1, 4: 5, 2: 1}})
    assert tuple(reports.error_rate(counts).first()) == (3, 1, 10, 0.1, 0.1)  # key 3 is once in two genomes, key 2 has two counts
    depth = spark.createDataFrame([(5.0, 2, 10), (2.5, 1, 3), (2.5, 1, 10), (1.0, 1, 30), (5.5, 1, 19)], "p double, m int, s int")
    assert [r[0] for r in depth.select(reports.depth_by_steps(depth.p, depth.m, depth.s)).collect()] == [2.0, None, 0.001, None, 2.5]
    assert [r[0] for r in depth.select(reports.depth_by_table(depth.p, depth.s)).collect()] == [2.49, None, 0.08, 0.02, 2.5]
    assert [r[0] for r in depth.select(reports.depth_by_offset(depth.p, depth.s, least_shared=8)).collect()] == [2.0, None, pytest.approx(10**-0.6), pytest.approx(10**-2.1), 2.5]
    shares = reports.relative_abundance(found, "sample", "percentage").collect()
    assert math.isclose(sum(r.percentage for r in shares), 100)
    order = spark.createDataFrame([("x", 1), ("y", 2)], "q string, place int")
    long = spark.createDataFrame([("x", "y", 0.5), ("y", "x", 0.5), ("x", "x", 0.0), ("y", "y", 0.0)], "q string, r string, value double")
    assert [tuple(r) for r in reports.phylip_rows(long, order).orderBy("place").collect()] == [(1, "Species001", "0.000000 0.500000"), (2, "Species002", "0.500000 0.000000")]
    assert reports.labelled(runs, "run", "n").count() == 2 and reports.weighted_alpha(found, "taxid", "percentage").first()[0] > 0
    assert spark.createDataFrame([("a b/c.1",)], "n string").select(safe_name("n")).first()[0] == "a_b_c.1"


def test_labels_and_trees(spark):
    files = spark.createDataFrame([(1, "x/GCA_1.1_a.fna"), (2, "GCF_1.1.fna"), (3, "GCA_1.1 again"), (4, "GCA_9.9"), (5, "GCA_2.1")], "place long, name string")
    species = spark.createDataFrame([("GCA_1.1", "E coli"), ("GCF_2.1", "B\tsub")], "accession string, species string")
    get = lambda wanted: [r.line for r in reports.selection_labels(files, species, wanted).orderBy("place").collect()]
    no = "0\tNULL\t"
    assert get(None) == ["1\tGCA_1.1\tE_coli", "2\tGCF_1.1\tE_coli", no + "GCA_1.1\tE_coli", no + "GCA_9.9", "3\tGCA_2.1\tB_sub"]
    assert get("B_sub") == [no + "GCA_1.1\tE_coli", no + "GCF_1.1\tE_coli", no + "GCA_1.1\tE_coli", no + "GCA_9.9", "3\tGCA_2.1\tB_sub"]
    assert get("^B_sub")[0] == "1\tGCA_1.1\tE_coli" and get("^B_sub")[4] == no + "GCA_2.1\tB_sub"
    with pytest.raises(ValueError):
        reports.selection_labels(files.unionByName(spark.createDataFrame([(6, "no")], files.schema)), species)
    trees = spark.createDataFrame([(1, "(Species001:0.1,(Species002:1,Species001:2)Species009);"), (2, "(a,b);")], "k long, t string")
    names = spark.createDataFrame([("Species001", "one"), ("Species002", "two"), ("Species002", "two b")], "code string, name string")
    assert {r.k: r.t for r in reports.renamed_tree(trees, "k", "t", names).collect()} == {1: "(one:0.1,(two:1,one:2));", 2: "(a,b);"}


def test_training_recovers_a_model(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(200, 3000, 900), *(rng.integers(0, 400, 900) for _ in range(3))], axis=1).astype(float)
    truth = {"denominators": np.array([[1, 1.2, 0.9, 1.1], [1, 0.8, 1.3, 1], [1.1, 1, 1, 0.7]]), "coefficients": np.array([0.1, 1e-5, 2e-5, 1e-5, 3e-5, 20, -9, 5, *[0.3] * 9])}
    y = training.design(x, truth["denominators"].ravel()) @ truth["coefficients"] + rng.normal(0, 1e-3, 900)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 0.5)], ", ".join(f"{c} double" for c in (*training.FEATURES, "d")))
    model = training.train_regression(rows, rows.d, sample_rows=400, rounds=60)
    assert model["rows"] == 900 and model["sigma"] < 1.5e-3
    error = rows.dropna().select(F.stddev(training.predicted(rows, model) - rows.d)).first()[0]
    assert error < 1.5e-3
    with pytest.raises(ValueError):
        training.train_regression(rows.limit(5), rows.d)
    assert abs(training.simplex_search(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.zeros(2), 500) - [3, -1]).max() < 1e-2


def test_running_sums_cross_the_runs(spark):
    rnd = random.Random(6)
    rows = [(g, o, rnd.randrange(9)) for g in "ab" for o in rnd.sample(range(-50, 200), 80)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): r.before for r in with_sum_before(df, "v", "o", ("g",), width=16).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
    assert with_sum_before(df.where("g = 'a'"), "v", "o", width=7).count() == 80


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "genome_id long, ctxobj long, cnt long")
    assert distance.sized_overlaps(empty, empty).count() == 0
    assert composite.composition(empty, empty).count() == 0
    assert setops.union(empty).count() == setops.markers(empty).count() == 0
    index = spark.createDataFrame([], "genome_id long, ctx long, obj long")
    assert ani.ani_table(index, index).count() == 0
