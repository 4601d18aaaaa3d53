"""Near-duplicates and the n-gram join against all pairs of a small table, SQL and each other."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rows import TEXTS, empty_table, odd_rows, odd_table

import corpus_pipeline
from checks.compare import connect, differences
from tickwright.llm import components, groups, minhash, signature_tree
from tickwright.llm.components import connected_components
from tickwright.llm.ngram_join import ngram_join
from tickwright.llm.queries import ORACLE, QUERIES


def shingles(text, width):
    words = bytes(text or "", "utf8").lower().split()
    width = min(width, len(words))
    return {tuple(words[at:at + width]) for at in range(len(words) - width + 1)} if words else set()


def brute(rows, width, percent):
    """Component of each id; ids are unique."""
    sets = {d: shingles(t, width) for d, t in rows}
    label = {d: d for d in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


def near_copies(seed, groups=12, width=60):
    """Texts in groups with more and more words changed, so that chains form."""
    draw, rows = random.Random(seed), []
    for group in range(groups):
        words = [f"g{group}w{draw.randint(0, 300)}" for _ in range(width)]
        for _ in range(draw.randint(1, 9)):
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(width)] = f"x{draw.randint(0, 999)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2)])
def test_chains_of_near_copies(spark, width, seed):
    rows = near_copies(seed)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_buckets_without_one_component_are_searched_through(spark):
    """Few loose tables put unlike texts into large buckets; no link may be lost there."""
    rows = near_copies(5, groups=6)
    base = " ".join(f"c{i}" for i in range(60))
    rows = [(d, f"{base} {t}") for d, t in rows]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), side=3, length=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 2, 80)


def test_odd_rows(spark):
    found = minhash.near_duplicates(odd_table(spark)).collect()
    assert len(found) == len(odd_rows())
    rows = {r.doc_id: r for r in found}
    expected = brute(list(TEXTS.items()), 2, 80)
    assert {d: (rows[d].n_shingles, rows[d].component_id) for d in TEXTS} == expected
    assert rows[2].component_id == 1 and rows[4].kept and rows[5].kept and rows[5].n_shingles == 0
    assert minhash.near_duplicates(empty_table(spark)).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op3_near_duplicates", "op13_ngram_join"])
def test_query_agrees_with_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    assert differences(QUERIES[name](spark, folder), ORACLE[name], connect(folder)) is None


@pytest.mark.parametrize("width", [2, 5])
def test_every_link_is_found(spark, width):
    """Against the join by rare shingles, which leaves no pair out by chance."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found, exact = (sorted((r.doc_id, r.component_id) for r in frame.collect())
                    for frame in (minhash.near_duplicates(docs, width, 80), ngram_join(docs, width, 80)))
    assert found == exact and len({c for _, c in exact}) < len(exact)


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 3), (2, 80, 4), (1, 60, 8), (3, 100, 9)])
def test_join_of_chains(spark, width, percent, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, width, percent).collect()} == expected
    cut = ngram_join(docs, width, percent, block_shingles=300, block_rows=5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in cut.collect()} == expected


@pytest.mark.parametrize("seed", [11])
def test_one_large_group_in_cells(spark, seed):
    """Copies of one text at all distances, most of them linked to it and some to each other alone."""
    draw, base = random.Random(seed), [f"b{i}" for i in range(80)]
    rows = []
    for doc_id in range(150):
        words = list(base if not rows or draw.random() < 0.6 else draw.choice(rows)[1].split())
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 40)}"
        rows.append((doc_id, " ".join(words[:draw.randint(60, 80)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent, function in ((2, 80, minhash.near_duplicates), (4, 85, ngram_join), (1, 90, ngram_join)):
        expected = brute(rows, width, percent)
        for blocks in [{"block_shingles": 700, "block_rows": 12}]:
            found = function(docs, width, percent, **blocks).collect()
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected, (width, blocks)


def test_near_copies_that_are_unlike_are_not_paired(spark, monkeypatch):
    """Copies of one text, each changed in places of its own and like no other: the rows of the
    blocks grow with the group and not with its square."""
    rows_in_blocks = []

    def counted(blocks, *given):
        rows_in_blocks.append(blocks.count())
        return links_of_blocks(blocks, *given)

    links_of_blocks = groups._links_of_blocks
    monkeypatch.setattr(groups, "_links_of_blocks", counted)
    draw = random.Random(3)
    rows = [(d, " ".join(f"b{i}" if i % 8 != d % 8 or draw.random() < 0.05 else f"x{d}w{i}" for i in range(120))) for d in range(120)]
    members = spark.createDataFrame([(0, d, 120) for d, _ in rows], "leader long, row long, n long")
    clusters = spark.createDataFrame([(d, 0) for d, _ in rows], "id long, label long")
    signed = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 1, lambda own: own.view(np.int64))
    numbered = signed.select(F.col("doc_id").alias("row"), F.col("marks").alias("shingles"))
    classes = numbered.select("row")
    found = groups._links_in(members, clusters, classes, lambda wanted: numbered.join(wanted, "row"),
                             signature_tree.Rule(95), block_shingles=1000, block_rows=8)
    assert [r for r in found.collect() if r.a != r.b] == [] and brute(rows, 1, 95) == {d: (120, d) for d, _ in rows}
    assert sum(rows_in_blocks) < 2 * len(rows)



@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_what_all_pairs_find(seed):
    random_numbers = np.random.default_rng(seed)
    base = random_numbers.integers(0, 1 << 62, 400)
    sets = []
    for _ in range(120):
        size = random_numbers.integers(1, 60)
        own = base[random_numbers.integers(0, 300) + np.arange(size)]
        sets.append(np.unique(np.where(random_numbers.random(size) < 0.1, random_numbers.integers(0, 1 << 62, size), own)))
    label = np.arange(len(sets)) if seed % 2 else random_numbers.integers(0, 100, len(sets))
    side = random_numbers.integers(1, 3, len(sets)) if seed > 1 else np.zeros(len(sets), dtype=int)
    percent = 60
    parent = {("l", int(v)): ("l", int(v)) for v in label}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if (seed < 2 or side[a] != side[b]) and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(("l", int(label[a])))] = root(("l", int(label[b])))
    expected = len({root(x) for x in parent})
    found = signature_tree.forest(np.concatenate(sets), np.array([len(s) for s in sets]), label.copy(), side, signature_tree.Rule(percent))
    assert len(set(label.tolist())) - len(found) == expected  # a forest: each link joins two components
    assert not any(label[a] == label[b] for a, b in found)


def test_texts_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "quite another text of its own"), (1, base), (5, base + " more"), (None, base), (None, "alone without an id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for function in (minhash.near_duplicates, ngram_join):
        found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in function(docs, 2, 80).collect()), key=str)
        assert found == sorted([(1, 5, 1), (1, 39, 1), (5, 40, 1), (None, 39, 1), (None, 4, None)], key=str)


def test_join_of_odd_rows(spark):
    found = ngram_join(odd_table(spark)).collect()
    assert len(found) == len(odd_rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute(list(TEXTS.items()), 4, 85)
    assert ngram_join(empty_table(spark)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = near_copies(7)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, __gone int")
    found = corpus_pipeline.near(spark, docs.withColumnRenamed("__gone", "component_id"), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(d for d, (_, c) in brute(rows, 5, 80).items() if d == c)
    assert found.columns == ["doc_id", "text", "component_id"]


def test_components_of_chains_stars_and_rings(spark):
    links = [(a, a + 1) for a in range(1, 40)] + [(100, b) for b in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    draw, label = random.Random(seed), {}
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(7, 7)]
    for a, b in links:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect()) == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_are_written_in_few_files(spark, monkeypatch):
    """Every file costs the executors processes of their own: a round's tables have as many as
    their rows need, however many partitions a shuffle has."""
    written = []

    def counted(df, label):
        written.append(stage(df, label))
        return written[-1]

    stage = components.stage
    monkeypatch.setattr(components, "stage", counted)
    draw = random.Random(5)
    links = [(draw.randrange(2000), draw.randrange(2000)) for _ in range(1500)]
    wanted = dict(connected_components(spark.createDataFrame(links, "a long, b long").coalesce(4)).collect())
    tables, files = len(written), sum(len(df.inputFiles()) for df in written)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        written.clear()
        assert dict(connected_components(spark.createDataFrame(links, "a long, b long").coalesce(4)).collect()) == wanted
        assert len(written) == tables and sum(len(df.inputFiles()) for df in written) <= 8 * tables
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert files <= 8 * tables


def test_components_of_chunks(spark, monkeypatch):
    """Links of one task come a few at a time, and the chunks' components are joined after."""
    monkeypatch.setattr(components, "CHUNK", 5)
    links = [(a, a + 1) for a in range(300, 0, -1)] + [(1000 - a, 1000) for a in range(1, 50)]
    expected = {**dict.fromkeys(range(1, 302), 1), **dict.fromkeys(range(951, 1001), 951)}
    found = components._stars(pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}))
    assert {b: a for a, b in zip(*found.to_pydict().values(), strict=True)} == {b: a for b, a in expected.items() if a != b}
    assert dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect()) == expected
