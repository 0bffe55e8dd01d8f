"""Near texts and near vectors against brute force, on odd rows and on groups that need several blocks."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from songloom.llm import near_vectors, ngram_join
from songloom.llm.components import components


def brute_groups(ids, near):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in near:
        parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    return {i: min(groups[root(i)]) for i in range(len(ids))}


def grams(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_texts(rows):
    sets = [grams(t) for _, t in rows]
    near = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    ]
    names = brute_groups([d for d, _ in rows], near)
    links = defaultdict(int)
    for i, j in near:
        links[i] += 1
        links[j] += 1
    return sorted((d, names[i], links[i], names[i] == d) for i, (d, _) in enumerate(rows))


def near_rows():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 400)}"
    base = [word() for _ in range(200)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one  two"), (6, "one two three")]
    for i in range(70):  # one group that links all around
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((10 + i, " ".join(text)))
    rows += [(100 + i, rows[6][1]) for i in range(5)]
    for i in range(40):
        text = [word() for _ in range(rng.randint(1, 60))]
        rows.append((200 + 2 * i, " ".join(text)))
        rows.append((201 + 2 * i, " ".join(text[:-1] + ["end"])))
    rng.shuffle(rows)
    return rows


def test_near_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string")
    got = sorted(map(tuple, ngram_join.near_groups(docs).collect()))
    assert got == brute_texts(rows)
    left = ngram_join.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, _, kept in got if kept)
    assert ngram_join.near_groups(docs.limit(0)).count() == 0
    twice = docs.where("doc_id in (4, 5)").unionByName(docs.where("doc_id = 4"))
    twice = twice.unionByName(spark.createDataFrame([(None, "one two", "k")], docs.schema))
    assert sorted(map(str, ngram_join.near_groups(twice).collect())) == sorted(
        [f"Row(doc_id={d}, class_id=4, n_links=3, kept={d == 4})" for d in (4, 4, 5, None)]
    )


def test_banding_reaches_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 160


def brute_vectors(rows, cosine=0.9):
    usable = {
        i: np.array(v, float) for i, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    near = [
        (i, j) for i in usable for j in usable
        if j < i and len(usable[i]) == len(usable[j])
        and usable[i] @ usable[j] / np.linalg.norm(usable[i]) / np.linalg.norm(usable[j]) >= cosine
    ]
    names = brute_groups([d for d, _ in rows], near)
    links = defaultdict(int)
    for i, j in near:
        links[i] += 1
        links[j] += 1
    return sorted((d, links[i], names[i], names[i] == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("dims", [1, 8])
def test_near_vectors(spark, dims, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 3)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    made = [(centres[i % 12] + rng.normal(size=dims) * rng.choice([0.05, 0.3, 1])).tolist() for i in range(500)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [None] * dims, [float("inf")] * dims, [1.0] * (dims + 1)]
    # Other lengths link among themselves, never across, although their leading components are the same.
    longer = [[*v, 0.0, 0.0] for v in made[:60]] + [[0.5] * (dims + 5)] * 3
    rows = list(enumerate(made + made[:30] + [made[0]] * 20 + odd + longer))
    table = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, links int")
    got = near_vectors.near_links(table.repartition(3), interval=50)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)
    assert near_vectors.near_links(table.limit(0)).count() == 0


def test_recursion_skips_only_what_is_far():
    rng = np.random.default_rng(0)
    x = near_vectors.unit(np.concatenate([rng.normal(size=(300, 6)) * 0.2 + c for c in rng.normal(size=(4, 6)) * 2]))
    order = near_vectors._spread_order(x, near_vectors.PIECE)
    x = x[order]
    ones = np.ones(len(x), np.int64)
    join = near_vectors.Join(x, x, ones, ones, np.eye(6), 0.9, True)
    join.meet(0, len(x), 0, len(x))
    assert (join.na == ((x @ x.T) >= 0.9).sum(1) - 1).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(400, 400)]
    nodes = sorted({x for link in links for x in link})
    place = {x: i for i, x in enumerate(nodes)}
    want = brute_groups(nodes, [(place[a], place[b]) for a, b in links])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[place[x]] for x in nodes}


def test_compare_block_needs_no_order():
    sets = [np.unique(np.random.default_rng(i % 3).integers(0, 1 << 60, 50)).astype("<u8").tobytes() for i in range(9)]
    table = pa.table({
        "leader": pa.array([b"a"] * 9), "p": pa.array([0] * 9), "q": pa.array([1] * 9), "rep": pa.array([bytes([i]) for i in range(9)]),
        "block": pa.array([i % 2 for i in range(9)]), "weight": pa.array([1] * 9), "leaders": pa.array([[b"a"]] * 9), "grams": pa.array(sets),
    })
    found = ngram_join.compare_block(table, 0.8)[0].to_pydict()
    assert dict(zip(found["rep"], found["links"])) == {
        bytes([i]): sum(j % 3 == i % 3 and j % 2 != i % 2 for j in range(9)) for i in range(9)
    }
