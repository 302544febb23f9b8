import random

import numpy as np

from folioscope.llm import containers as ct


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def used(filled):
    return sum(t for t, _ in filled)


def fewest(sizes, capacity):
    """Exact number of containers for a few items."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= sizes[i] and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] - sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def test_packing_is_valid_and_close_to_the_best():
    r = random.Random(1)
    over = 0
    for _ in range(60):
        capacity = r.choice([10, 20, 50])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 9))), reverse=True)
        filled = ct.pack_sizes(histogram(sizes, capacity), capacity)
        assert all(sum(s * n for s, n in u.items()) <= capacity for _, u in filled)
        packed = np.zeros(capacity + 1, np.int64)
        for times, u in filled:
            for s, n in u.items():
                packed[s] += times * n
        assert (packed == histogram(sizes, capacity)).all()
        over += used(filled) - fewest(sizes, capacity)
    assert over <= 2


def test_dominance_never_costs_a_container():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.choice([10, 17, 30])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        stock = ct.Stock(histogram(sizes, capacity))
        ct.reduce_by_dominance(stock, capacity)
        rest = sorted(np.repeat(np.arange(capacity + 1), stock.left).tolist(), reverse=True)
        assert used(stock.filled) + fewest(rest, capacity) == fewest(sizes, capacity)


def test_table(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([7, 64, 100, *(r.randint(1, 260) for _ in range(5))]), "x") for i in range(2000)]
    df = spark.createDataFrame(sizes + [(None, 5, "x"), (5000, None, "x"), (5001, 0, "x")], "doc_id bigint, n bigint, units string")
    rows = ct.fill_containers(df, "doc_id", "n", 100).collect()
    total = {}
    load = {}
    for x in rows:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_units
        load[x.container_no] = load.get(x.container_no, 0) + x.n_units
        assert x.first_unit == 100 * x.piece_no
    assert total == {i: n for i, n, _ in sizes} and max(load.values()) <= 100
    assert set(load) == set(range(len(load))) and len(load) <= 1.03 * sum(total.values()) / 100
    assert all(sum(1 for x in rows if x.doc_id == i) == 1 for i, n, _ in sizes[:200] if n <= 100)
    split = ct.fill_containers(df, "doc_id", "n", 100, rows_per_bucket=70).collect()
    loads = {}
    for x in split:
        loads[x.container_no] = loads.get(x.container_no, 0) + x.n_units
    assert sorted((x.doc_id, x.piece_no, x.n_units) for x in split) == sorted((x.doc_id, x.piece_no, x.n_units) for x in rows)
    assert sorted(loads.values()) == sorted(load.values())
    assert ct.fill_containers(df.limit(0), "doc_id", "n", 100).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id bigint, text string")
    rows = ct.fill_documents(df, "doc_id", "text").collect()
    assert {x.doc_id for x in rows} == {1, 4} and sum(x.n_units for x in rows if x.doc_id == 4) >= 5000


def test_reduction_fixes_an_exact_pair():
    stock = ct.Stock(histogram([60, 40, 55, 44, 5, 5], 100))
    ct.reduce_by_dominance(stock, 100)
    assert any(u == {60: 1, 40: 1} for _, u in stock.filled)


def test_wrong_placements_are_told(spark):
    sizes = spark.createDataFrame([(1, 60), (2, 50), (3, 150), (4, 30), (5, 20)], "doc_id bigint, n bigint")
    placed = [(1, 0, 0, 60, 0), (2, 0, 0, 50, 0), (3, 0, 0, 100, 1), (3, 1, 100, 50, 2), (4, 0, 0, 10, 3), (4, 1, 100, 20, 3)]
    df = spark.createDataFrame(placed, "doc_id bigint, piece_no int, first_unit bigint, n_units int, container_no bigint")
    got = {r.doc_id: (r.fits, r.whole) for r in ct.checked_containers(sizes, df, "doc_id", "n", 100).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, True), 4: (True, False), 5: (False, False)}
