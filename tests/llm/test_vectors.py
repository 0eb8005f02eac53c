"""Vector operators against brute force in plain numpy and Python integers, on odd vectors of all kinds."""

import hashlib

import numpy as np
import pytest

from recordloom.llm import embed_dedup, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v string, id string"


def frame(spark, rows, schema=SCHEMA):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], schema)


def lloyd(rows, parts=4, entries=256, rounds=4):
    """Codes and books step by step: rows (id, vector, label), all of one length."""
    ints = [[int(np.floor(1024 * x)) for x in v] for _, v, _ in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in ints] for p in range(parts)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = [[list(cut[p][i]) for i in order] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(p, x), []).append(x)
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = {}
    for i, (vec_id, _, label) in enumerate(rows):
        codes = [nearest(p, cut[p][i]) for p in range(parts)]
        out[vec_id] = ("".join(f"{c:02x}" for c in codes), sum(distance(cut[p][i], books[p][c]) for p, c in enumerate(codes)), label)
    text = ",".join(str(x) for part in books for e in part for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def codes_of(df, **options):
    coded, books = vector_codes.compress(df, **options)
    found = vector_codes.with_label_error(coded).collect()
    return {r["vec_id"]: (r["code"], r["error"], r["label"]) for r in found}, vector_codes.books_digest(books), found


@pytest.mark.parametrize("n, spread, entries", [(700, 0.3, 32), (40, 0.3, 256), (600, 0.004, 16), (1, 1.0, 256)])
def test_codes_as_step_by_step(spark, n, spread, entries):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 16))
    # small spreads make many equal parts and ties; a third of the vectors are one
    vectors = [np.round(centres[0] if rng.random() < 0.33 else centres[rng.integers(9)] + rng.normal(size=16) * spread, 3).tolist() for _ in range(n)]
    ids = rng.permutation(5 * n)[:n] - n
    rows = [(int(i), v, None if k % 5 == 0 else k % 3) for k, (i, v) in enumerate(zip(ids, vectors))]
    expected, digest = lloyd(rows, entries=entries)
    found, books, all_rows = codes_of(frame(spark, rows).repartition(3), entries=entries)
    assert found == expected and books == digest
    sums = {}
    for _, error, label in expected.values():
        sums[label] = sums.get(label, 0) + error
    assert {(r["label"], r["label_error"]) for r in all_rows} == set(sums.items())


def test_codes_of_odd_vectors(spark):
    fine = [(i, [i / 7 - 1, 0.5, -0.25, float(i % 3), 2.0 * i], 1) for i in range(12)]
    odd = [
        (50, None, 1), (51, [], 1), (52, [None, 1.0, 1.0, 1.0, 1.0], 1), (53, [float("nan"), 1.0, 1.0, 1.0, 1.0], 1),
        (54, [float("inf"), 1.0, 1.0, 1.0, 1.0], None), (55, [1.0, 2.0], 1), (56, [1e300, 1.0, 1.0, 1.0, 1.0], 1), (57, [1e12, 0.0, 0.0, 0.0, 0.0], 1),
    ]
    found, digest, _ = codes_of(frame(spark, fine + odd))
    padded = [(i, v + [0.0] * 3, label) for i, v, label in fine]  # five components are filled up to eight
    expected, books = lloyd(padded)
    assert found == expected and digest == books
    none, digest, rows = codes_of(frame(spark, odd[:5]))
    assert none == {} and rows == [] and digest == hashlib.sha256(b"").hexdigest()


def test_codes_of_repeated_and_missing_ids(spark):
    rows = [(None, [9.0, 9.0, 9.0, 9.0], 1), (3, [1.0, 2.0, 3.0, 4.0], 1), (3, [5.0, 6.0, 7.0, 8.0], None), (3, [1.0, 2.0, 3.0, 4.0], 1)]
    coded, books = vector_codes.compress(frame(spark, rows), entries=3, rounds=0)
    # smallest ids first, ties by the vector, no id last: entries are 1 2 3 4 twice and 5 6 7 8
    assert books[:, :, 0].tolist() == [[1024, 1024, 5120], [2048, 2048, 6144], [3072, 3072, 7168], [4096, 4096, 8192]]
    assert sorted((r["vec_id"] is None, r["code"], r["error"]) for r in coded.collect()) == [(False, "00000000", 0), (False, "00000000", 0), (False, "02020202", 0), (True, "02020202", 1024**2 * (16 + 9 + 4 + 1))]


def test_tree_assigns_every_place_once():
    rng = np.random.default_rng(5)
    for n in (1, 31, 33, 500):
        for points in (rng.integers(-5, 5, (n, 3)), rng.integers(-(1 << 25), 1 << 25, (n, 3)), np.zeros((n, 3), np.int64)):
            tree, entries = vector_codes.Tree(points), points[rng.integers(0, n, 20)]
            read = vector_codes.Tree.read(tree.stored(), 3)
            best = ((points[:, None, :] - entries) ** 2).sum(2).argmin(1)
            found, seen = np.zeros(n, int), 0
            for start, end, entry, whole in read.assigned(entries):
                found[tree.order[start:end]] = entry
                seen += end - start
                assert whole is None or (whole == tree.points[start:end].sum(0)).all()
            assert seen == n and (found == best).all()


def linked(rows, similarity=0.93):
    """n_links, component and kept of each row by comparing all: (id, vector, label)."""
    usable = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / max(map(abs, r[1])) if u else None for r, u in zip(rows, usable)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity] for i in range(len(rows))]
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(near[i]), least, row[0] == least if row[0] is not None and least is not None else not near[i]))
    return sorted(out, key=repr)


def found_links(df):
    return sorted((tuple(r) for r in embed_dedup.near_vectors(df).collect()), key=repr)


@pytest.mark.parametrize("block", [512, 20])
def test_links_of_families(spark, monkeypatch, block):
    """Balls, families wider than a ball, chains, copies, and strangers; small blocks make pivots and tiles of them."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x)
    centres = [unit(rng.normal(size=24)) for _ in range(6)]
    vectors = [unit(centres[0] + 0.02 * rng.normal(size=24)) for _ in range(90)]  # a ball
    vectors += [unit(centres[1] + 0.055 * rng.normal(size=24)) for _ in range(90)]  # many of these pairs are near the threshold
    vectors += [centres[2]] * 30 + [3.0 * centres[2]] * 3  # copies, and of another length
    a, b = centres[3], unit(centres[4] - (centres[4] @ centres[3]) * centres[3])
    vectors += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.09)]  # a chain
    vectors += [unit(rng.normal(size=24)) for _ in range(120)]
    ids = rng.permutation(len(vectors))
    rows = [(int(i), [float(x) for x in v], 1 if k % 11 else 2) for k, (i, v) in enumerate(zip(ids, vectors))]
    assert found_links(frame(spark, rows).repartition(4)) == linked(rows)


def test_links_of_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [
        (1, v, 1), (2, w, 1), (3, v, None), (4, v, 2), (5, v + [0.0], 1), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [None, 1.0, 1.0], 1),
        (10, [float("nan"), 1.0, 1.0], 1), (11, [float("inf"), 1.0, 1.0], 1), (None, v, 1), (None, [-1.0, 0.0, 0.0], 3), (None, [-1.0, 0.1, 0.0], 3), (None, v, None),
        (12, [5.0], 4), (13, [1e-300], 4), (14, [-5.0], 4), (15, [1e300, 1e300], 4), (16, [1e-300, 1.1e-300], 4), (17, [0.0, 1.0], 4),
        (20, [1.0, 0.0], 5), (20, [0.0, 1.0], 5), (20, [1.0, 0.0], 5),
    ]
    found = found_links(frame(spark, rows))
    assert found == linked(rows)
    assert {r[0]: r[1:] for r in found if r[0] in (1, 2, 5)} == {1: (2, 1, True), 2: (2, 1, False), 5: (0, 5, True)}
    assert found_links(frame(spark, rows).limit(0)) == [] and found_links(frame(spark, [(1, None, 1)])) == [(1, 0, 1, True)]


@pytest.mark.parametrize("d, words", [(64, 512), (64, 64), (3, 64), (300, 128)])
def test_pairs_at_the_threshold_share_a_filter(d, words):
    rng = np.random.default_rng(d)
    a = embed_dedup.directed(rng.normal(size=(1500, d)))
    other = rng.normal(size=a.shape)
    other = embed_dedup.directed(other - (other * a).sum(1, keepdims=True) * a)
    b = embed_dedup.directed(0.93 * a + np.sqrt(1 - 0.93**2) * other)
    of_a, of_b = (embed_dedup.filters(x, words, 0.93) for x in (a, b))
    missed = sum(not set(x.tolist()) & set(y.tolist()) for x, y in zip(of_a, of_b))
    assert missed <= 3
    # what a vector exceeds does not depend on who asks
    assert all((embed_dedup.filters(a[i : i + 1], words, 0.93)[0] == of_a[i]).all() for i in range(0, 1500, 97))
    code, height = embed_dedup.codes(d, words, 0.93)[0]
    first, second = code.products(a[:5])
    for listed, x, y in zip(code.exceeded(a[:5], height), first, second):
        every = np.sort((x[:, None] + y).ravel())
        assert sorted(listed) == np.flatnonzero((x[:, None] + y).ravel() >= min(height, every[-embed_dedup.LEAST])).tolist()
