import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from recordloom.llm import near_dup, substring_dedup
from recordloom.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] * bool(w))


def linked(docs, percent):
    """Components of all pairs that are similar, by brute force over pairs of distinct sets that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    first, parent = {}, {}
    for i, s in sorted(sets.items()):
        parent[i] = first.setdefault(s, i) if s else i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for s, i in first.items():
        for e in s:
            holders[e].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs, percent):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows, percent=percent).collect()}
    assert found == linked(docs, percent)


def test_real_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, docs, 85)


def test_large_families_and_common_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    passages = [[word() for _ in range(40)] for _ in range(3)]
    docs = []
    for family in range(2):
        base = [word() for _ in range(120)]
        for _ in range(90):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6))):
                copy[rng.randrange(len(copy))] = word()
            if family and rng.random() < 0.4:
                copy += rng.choice(passages)[:15]
            docs.append(copy[: rng.choice((120, 120, 118, 104))])
    docs += [rng.choice(passages) + [word() for _ in range(rng.choice((2, 20, 60)))] for _ in range(120)]
    rng.shuffle(docs)
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], 80)


def test_small_and_missing_texts(spark):
    docs = [(1, "A b\tc"), (2, "a B c"), (3, "a b"), (4, ""), (5, " \n"), (6, None), (7, "a b c d e"), (9, "x " * 3000), (8, "X " * 4000)]
    rows = spark.createDataFrame([(i, t, "u", 1) for i, t in docs] + [(None, "a b c", "u", 1), (3, "a b", "u", 2)], "doc_id long, text string, rep string, n int")
    found = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(rows).collect())
    assert found == [(0, 1, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)]
    assert near_dup.near_duplicates(rows.limit(0)).count() == 0


def test_copies_near_copies_and_cuttings_of_one_document(spark):
    """A third exact copies of one text, many near copies of another, many cuttings of a long one, one common passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    long = [word() for _ in range(700)]
    cuttings = []
    for _ in range(250):
        begin, size = rng.randrange(400), rng.choice((60, 90, 110, 130, 150, 300))
        cuttings.append(long[begin : begin + size] + [word() for _ in range(rng.choice((0, 0, 3)))])
    base, passage = [word() for _ in range(100)], [word() for _ in range(30)]
    near = []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(100)] = word()
        near.append(copy)
    mixed = [passage + [word() for _ in range(rng.choice((1, 4, 5, 6, 7, 40)))] for _ in range(200)]
    docs = [" ".join(d) for d in cuttings + near + mixed] + [" ".join(base[:50])] * 3000
    rng.shuffle(docs)
    check(spark, list(enumerate(docs)), 85)


def test_edited_copies_of_one_document_are_not_all_paired(spark, monkeypatch):
    """Copies that differ in many words each: few of the pairs that one family has can be similar, and only those meet full sets."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    base, docs = [word() for _ in range(400)], []
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.choice((3, 6, 7, 8, 9, 10, 11))):
            copy[rng.randrange(400)] = word()
        docs.append(" ".join(copy))
    confirmed, sent = near_dup._confirmed, []

    def counted(pairs, sets, percent):
        sent.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(near_dup, "_confirmed", counted)
    check(spark, list(enumerate(docs)), 85)
    assert sum(sent) < 10 * len(docs)  # of 12,720 pairs


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(3, "a b c"), (5, "a b c"), (5, "x y z"), (4, "x y z"), (9, "q r s"), (9, "q r s"), (8, None), (8, "l m n"), (2, "l m n")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found.collect() if r["n_shingles"]} == {
        (3, 3, True), (5, 3, False), (4, 3, False), (9, 9, True), (8, 2, False), (2, 2, True),
    }


def test_what_is_asked_of_sketches_is_missed_by_less_than_one_in_a_million_million():
    for percent, values, least in ((80, 32, 7), (85, 32, 10), (80, 64, 26), (85, 64, 30), (100, 32, 32)):
        assert near_dup.least_shared(values, percent) == least


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links[:-2]:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    alone = [n for n, k in Counter(find(n) for n in parent).items() if k == 1]
    assert found == {n: find(n) for n in parent if find(n) not in alone}


def removed(docs, window=13):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def cut(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()}


def test_repeated_windows(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(6)] + ["é", "The", "the"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 60))] for _ in range(12)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.5 else [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(30)]
        docs.append((i, " ".join(text)))
    docs += [(200, "the " * 2000), (201, "the " * 1500), (202, "a the " * 900), (203, None), (204, ""), (205, "\n\t ")]
    rng.shuffle(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert cut(substring_dedup.substring_dedup(rows)) == removed(docs)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(substring_dedup, "GATHER", 300)
    assert cut(substring_dedup.substring_dedup(rows)) == removed(docs)


def test_real_passages(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert cut(substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == removed(docs)


def test_rows_without_ids_and_other_columns(spark):
    text = " ".join(map(str, range(20)))
    rows = spark.createDataFrame([(None, text, "x", 5), (1, text, "y", 5), (2, "0 " + text, None, 5), (2, "0 " + text, None, 6)], "doc_id long, text string, doc string, n_words int")
    found = substring_dedup.substring_dedup(rows)
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept"], [tuple(x) for x in r["removed"]]) for r in found.collect()) == [(0, 0, text, []), (1, 0, text, []), (2, 20, "0", [(1, 21)]), (2, 20, "0", [(1, 21)])]
    assert "doc" in found.columns and substring_dedup.substring_dedup(rows.limit(0)).count() == 0


def test_split_blocks_lose_nothing(spark, monkeypatch):
    """A gram in every document, in contexts of its own and in common ones: its block is split, and the result is that of brute force."""
    rng = random.Random(6)
    hot = [f"h{i}" for i in range(7)]
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(6):
            words += [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 9))] + hot
            if rng.random() < 0.2:
                at = rng.randrange(15)
                words += common[at : at + 15]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = {}
    first: dict = {}
    for i, text in rows:
        words = text.split(" ")
        gone = set()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            if first.setdefault(w, i) < i:
                gone |= set(range(k, k + 13))
        expected[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "LEAST", 50)
    plain = docs.selectExpr("doc_id AS doc", "text")
    blocks = -(-sum(len(t) for _, t in rows) // 4000)
    splits = substring_dedup._splits(plain, 13, blocks)
    assert splits and max(splits.values()) > 2
    packed = plain.mapInArrow(substring_dedup._windows(13, blocks, splits), "block int, sub int, " + ", ".join(f"{n} binary" for n in substring_dedup.PACKED.names[2:]))
    sizes = sorted(r["n"] for r in packed.groupBy("block", "sub").agg(F.sum(F.octet_length("marks")).alias("n")).collect())
    assert sizes[-1] <= 6 * sizes[len(sizes) // 2]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert found == expected and sum(n for _, n, _ in expected.values()) > 500


def test_windows_are_hashed_in_parts(monkeypatch):
    """A task's memory beside what it sends does not follow the words that it gathers, and the parts do not show in what is sent."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(300)), "text": texts})
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        counts = list(substring_dedup._sizes(13, 5)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert sum(counts[0].column("n").to_pylist()) == 300 * 1988
    assert most < 24 << 20, most
    sent = list(substring_dedup._windows(13, 5, {2: 3})(iter([batch])))
    monkeypatch.setattr(substring_dedup, "PART", 1 << 30)
    assert sent == list(substring_dedup._windows(13, 5, {2: 3})(iter([batch])))
