"""Operators 11 to 13 against brute force; nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.conftest import SMALL
from trackloom.llm import importance, merkle, setsketch
from trackloom.llm import queries as q
from trackloom.llm.tables import new_path, ranked


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(1, "", "a"), (2, None, None), (3, long, "b"), (4, long, "b"), (4, long, "b"), (None, "no id here, five words\nor more", "a"), (None, None, None), (7, "--- ...", None), (8, "one", "c"), (9, "One", "c"), (10, "\0  \U0001f600 x", "c")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint"))
    return made.withColumns({c: F.lit(1) for c in ("id", "row", "key", "place", "at", "part", "tie", "node", "score", "rank", "label", "tree", "digest", "held")})


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_setsketch_dedup", "op13_importance_resampling"])
def test_queries_equal_sql(spark, con, name):
    assert differences(spark, con, q.queries()[name], q.oracle_sql()[name], SMALL) == []


def test_places_under_hot_and_repeated_keys(spark):
    rows = [("h", 5)] * 700 + [("h", k) for k in range(50)] + [(None, k % 7) for k in range(300)] + [("x", None)] * 40
    df = spark.createDataFrame(rows, "s string, k int").withColumn("place", F.lit("own"))
    got = ranked(df, [F.col("k").asc_nulls_first()], ["s"], name="at").collect()
    for s in ("h", None, "x"):
        own = sorted((r.at, -1 if r.k is None else r.k) for r in got if r.s == s)
        assert [at for at, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert sorted(r.at for r in ranked(df, [F.col("k").desc_nulls_last()], name="at").collect()) == list(range(len(rows)))


# 11


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields) -> str:
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(nodes: list[str], arity: int) -> list[list[str]]:
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([sha(*tree[-1][k : k + arity]) for k in range(0, len(tree[-1]), arity)])
    return tree


def plain_siblings(tree: list[list[str]], place: int, arity: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        low = place - place % arity
        out.append(("".join(level[low:place]), "".join(level[place + 1 : low + arity])))
        place //= arity
    return out


@pytest.mark.parametrize(("arity", "every"), [(3, 4), (2, 1), (3, 2), (5, 3)])
def test_proofs_equal_brute_force(spark, arity, every):
    rng = random.Random(arity * 10 + every)
    rows = [(k, f"s{rng.choice('aaaab')}" if k % 9 else None, f"text {k}\n", 5) for k in range(250)] + [(1000, "lone", "x\n", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_chars bigint").withColumn("lang", F.lit(None).cast("string"))
    manifest = merkle.write_manifest(docs, new_path(spark, "test"), arity=arity, every=every, held={"claimed": merkle.tampered_leaf()})
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r[0], r[1], None, r[3], r[2])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([d for _, d in sorted(groups[s])], arity) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order], arity)
    assert merkle.read_manifest(spark, manifest.folder).root == top[-1][0] and {r.source: r.subroot for r in manifest.sources.collect()} == {s: trees[s][-1][0] for s in order}
    got = {r.id: r for r in merkle.proved(manifest).collect()}
    assert len(got) == len(rows)
    for i, s in enumerate(order):
        for place, (key, digest) in enumerate(sorted(groups[s])):
            steps = plain_siblings(trees[s], place, arity) + plain_siblings(top, i, arity)
            tampered = zlib.crc32(str(key).encode()) % 2 == 0
            root = plain_leaf(key, s, None, next(r[3] for r in rows if r[0] == key), next(r[2] for r in rows if r[0] == key).replace("\n", "")) if tampered else digest
            for before, after in steps:
                root = sha(before, root, after)
            want = (digest, trees[s][-1][0], top[-1][0], sha(*[b + a for b, a in steps]), root, root == top[-1][0])
            assert tuple(got[key])[1:] == want and got[key].verified == (not tampered)
    levels = [f for f in manifest.levels.items()]
    assert dict(levels)["leaves"] == max(1, math.ceil(max(len(t) - 1 for t in trees.values()) / every))


def test_manifests_of_odd_rows_and_nothing(spark, odd):
    manifest = merkle.write_manifest(odd, new_path(spark, "test"), held={"claimed": merkle.tampered_leaf()})
    got = merkle.proved(manifest).collect()
    rows = odd.collect()
    assert sorted(r.leaf for r in got) == sorted(plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in rows)
    assert all(r.verified for r in got if r.id is None) and sum(r.leaves for r in manifest.sources.collect()) == len(rows)
    again = merkle.write_manifest(odd.repartition(5), new_path(spark, "test"))
    assert again.root == manifest.root  # whatever the order and the partitions
    nothing = merkle.write_manifest(odd.limit(0), new_path(spark, "test"))
    assert nothing.root is None and merkle.proofs(nothing).count() == 0


# 12


def plain_shingles(text: str | None, n: int = 2) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def plain_components(rows: list[tuple]) -> dict:
    sets = [(i, plain_shingles(t)) for i, t in rows]
    of = {i: i for i, _ in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def groups(rng: random.Random) -> list[tuple]:
    """Exact copies, near copies about the threshold in chains and stars, short texts and texts with a common passage."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size in (3, 8, 40, 120):
        base = [word() for _ in range(size)]
        for _ in range(25):
            texts.append(" ".join(w if rng.random() > rng.choice([0, 0.02, 0.05, 0.08]) else word() for w in base))
        chain = list(base)
        for _ in range(12):
            chain[rng.randrange(size)] = word()
            texts.append(" ".join(chain))
    shared = " ".join(word() for _ in range(60))
    texts += [f"{shared} {' '.join(word() for _ in range(rng.choice([2, 8, 30])))}" for _ in range(60)]
    texts += ["One", "one", " ONE\t", "two", "", "  ", "a b a b", "a b a b a b", "b a b a"]
    return [(k * 3, t) for k, t in enumerate(rng.sample(texts, len(texts)))]


@pytest.mark.parametrize(("leaders", "block"), [(2, 8192), (1, 16), (0, 8192)])
def test_components_equal_brute_force(spark, leaders, block, monkeypatch):
    monkeypatch.setattr(setsketch, "SETS", 7)  # many pairs of blocks
    rows = groups(random.Random(leaders))
    got = setsketch.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), leaders=leaders, block=block).collect()
    want = plain_components(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_components_of_odd_rows(spark, odd):
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_copies(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 700, 3, True), (4, 700, 3, False), (4, 700, 3, False), (None, 6, None, True), (None, 0, None, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 2, 10, True)], key=str)
    assert setsketch.near_copies(odd.limit(0)).count() == 0
    kept = setsketch.without_copies(odd)
    assert kept.columns == odd.columns and sorted(((r.doc_id, None if r.text is None else len(r.text)) for r in kept.collect()), key=str) == sorted([(1, 0), (2, None), (3, len(odd.where("doc_id = 3").first().text)), (None, 30), (None, None), (7, 7), (8, 3), (10, 6)], key=str)


def test_a_group_of_one_key_and_its_near_copies(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(300)] + [(1000 + k, " ".join([*base[: k % 90], f"x{k}", *base[k % 90 + 1 :]])) for k in range(300)] + [(5000 + k, " ".join(f"z{rng.randrange(9999)}" for _ in range(30))) for k in range(200)]
    got = {r.id: r.component_id for r in setsketch.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == (0 if k < 5000 else k) for k in got) and len(got) == len(rows)


def test_registers_merge_and_estimate(spark):
    rng = random.Random(1)
    a, b = [f"{rng.random()}" for _ in range(2000)], [f"{rng.random()}" for _ in range(500)]
    texts = [(0, "s", " ".join(a)), (1, "s", " ".join([*a[1000:], *b])), (2, "all", " ".join([*a, *b]))]
    sketches = setsketch.sketched(spark.createDataFrame(texts, "doc_id bigint, by string, text string")).withColumn("by", F.when(F.col("id") < 2, "s").otherwise("all"))
    merged = {r.by: r for r in setsketch.merge_sketches(sketches, "by").withColumn("size", setsketch.cardinality(F.col("registers"))).collect()}
    equal = np.mean(np.array(merged["s"].registers) == np.array(merged["all"].registers))
    assert equal > 0.97  # of one shingle at each seam the sets differ
    assert abs(merged["all"].size / 2500 - 1) < 0.4
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 1000, dtype=np.uint64)) for k in range(2)]
    sets[1] = np.unique(np.concatenate([sets[0][:800], sets[1][:200]]))
    x, y = setsketch.registers_of(sets, 1024)
    told = [np.array([float(v)]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), 1000, 1000)]
    assert abs(setsketch.joint_estimate(*told)[0] - 800 / 1200) < 0.06
    assert setsketch.merge_sketches(sketches.limit(0), "by").count() == 0


# 13


def test_hashes_and_interning():
    rng = random.Random(2)
    pieces = [rng.randbytes(rng.choice([0, 1, 3, 4, 7, 8, 11, 12, 16, 31, 32, 33, 100])) for _ in range(3000)] + [b"same"] * 500 + [b"a" * 9, b"a" * 10, b"a" * 17] * 3
    data = np.frombuffer(b"".join(pieces) + b" " * 8, dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    assert [int(k) for k in importance.hash_keys(data, starts, sizes)] == [xxhash.xxh64_intdigest(p) for p in pieces]
    for keys in (None, np.zeros(len(pieces), dtype=np.uint64), sizes.astype(np.uint64)):  # equal keys of different pieces are told apart by their bytes
        table = importance.Interned(data, starts, sizes, 97, keys)
        assert len(table.filled) == len(set(pieces))
        assert all(pieces[table.owner[s]] == p and table.count[s] == pieces.count(p) and table.bucket[s] == zlib.crc32(p) % 97 for s, p in list(zip(table.slot, pieces, strict=True))[::50])


@pytest.mark.parametrize("ngram", [1, 3])
def test_scores_equal_brute_force(spark, ngram):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "日本語", "A", "a"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 50]))) + rng.choice(["", "!", " -- "])) for k in range(400)] + [(500, None)]
    target = [(k, ", ".join(rng.choices(words[:40], k=30))) for k in range(20)]

    def features(text: str | None) -> list[str]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return [" ".join(w[k : k + n]) for n in range(1, ngram + 1) for k in range(len(w) - n + 1)]

    buckets = 500
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, rows), (t, target)):
        for _, text in texts:
            for f in features(text):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    want = {}
    for key, text in rows:
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        n_words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")))
        want[key] = [n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((k for k in want if want[k][0] >= 20), key=lambda k: (-want[k][3], k))
    for place, key in enumerate(able[: 10 * len(able) // 100], start=1):
        want[key][4] = place
    docs, goal = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(target, "item_id bigint, text string")
    got = importance.draw_scores(docs, goal, ngram=ngram, buckets=buckets).collect()
    assert {r.id: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got} == want
    drawn = importance.importance_sample(docs.withColumn("score", F.lit("own")), goal, ngram=ngram, buckets=buckets)
    assert drawn.columns == ["doc_id", "text", "score"] and sorted(r.doc_id for r in drawn.collect()) == sorted(k for k in want if want[k][4])


def test_scores_of_odd_rows(spark, odd):
    benchmark = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = importance.draw_scores(odd, benchmark, percent=50).collect()
    assert len(got) == odd.count() and sorted((r.id, r["rank"]) for r in got if r["rank"]) == [(4, 1)] or sorted((r.id, r["rank"]) for r in got if r["rank"]) == [(3, 1)]
    assert all(r.weight == 0 and r["rank"] is None for r in got if not r.n_features)
    assert importance.draw_scores(odd.limit(0), benchmark).count() == 0 and importance.importance_sample(odd.limit(0), benchmark).count() == 0
    assert importance.draw_scores(odd, benchmark.limit(0)).count() == odd.count()
