"""The ten operators against brute-force versions, SQL, round trips and held-out labels; nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.conftest import SMALL
from trackloom.llm import queries as q

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str, n: int = 5) -> set:
    words = re.findall(WORDS, lower(text))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.fixture(scope="module")
def documents():
    return connect(SMALL).execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(1, "", "a"), (2, None, None), (3, long, "b"), (4, long, "b"), (4, long, "b"), (None, "no id here, five words", "a"), (7, "--- ...", None), (8, "one", "c"), (9, "\0  \U0001f600 x", "c")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return made.withColumns({c: F.lit(1) for c in ("id", "row", "bucket", "node", "size", "score", "start", "kind", "label")})


def test_chat_reads_back(spark):
    rows = connect(SMALL).execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall()
    said = "\\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for conv, role, text in [*rows, (-7, "user", said), (-7, "assistant", said)]:
        turns[conv].append((role or "", text))
    got = {r.conv_id: r for r in q.op1_chat_formatting(spark, SMALL).collect()}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        learned = "".join(t for role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[conv].formatted_chars >= sum(len(t) for _, t in own)


def test_license_base_places(spark, documents):
    phrases = {"mit": "mit license".split(), "apache": "apache license".split(), "gpl": "general public license".split()}
    got = {r.doc_id: r for r in q.op2_license_scan(spark, SMALL).collect()}
    for doc, text in documents:
        words = re.findall(WORDS, lower(text))
        places = sorted((k, name) for name, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p)
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({n for _, n in places}))
        assert {n for _, n in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_near_duplicates_are_all_links(spark, documents):
    sets = {d: shingles(t) for d, t in documents}
    words = {d: re.findall(WORDS, lower(t)) for d, t in documents}
    links = defaultdict(set)
    for i, (a, s) in enumerate(documents):
        for b, t in documents[:i]:
            same = words[a] == words[b] if words[a] or words[b] else s == t
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                links[a].add(b)
                links[b].add(a)
    root = {d: d for d, _ in documents}
    for _ in documents:
        new = {d: min([root[d], *(root[x] for x in links[d])]) for d in root}
        if new == root:
            break
        root = new
    got = {r.doc_id: (r.class_id, r.n_links) for r in q.op3_ngram_jaccard_join(spark, SMALL).collect()}
    assert got == {d: (root[d], len(links[d])) for d in root}


def test_near_duplicates_in_large_groups(spark):
    """Groups beyond one block of either kind are dealt out as pairs of blocks and lose no link."""
    from trackloom.llm.near_duplicates import near_duplicates

    rng = random.Random(3)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(90):
        text = list(base)
        text[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(text)))
    sets = {k: shingles(t) for k, t in rows}
    want = {a: sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets if b != a) for a in sets}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=16, verify_block=16).collect()
    assert {r.id: r.n_links for r in found} == want


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    """Near copies of unequal texts under one repeated id or null ids are one class; other texts under the same ids stay."""
    from trackloom.llm.near_duplicates import keep_one

    rng = random.Random(8)
    bases = [[f"c{k}w{rng.randrange(900)}" for _ in range(80)] for k in range(8)]
    near = lambda k, j: " ".join([*bases[k][:-1], f"end{j}"])
    ids = [lambda j: 7, lambda j: None, lambda j: 7 if j % 2 else None, lambda j: 7, lambda j: 100 + j, lambda j: None, lambda j: 7 if j else None, lambda j: j]
    rows = [(ids[k](j % 4), near(k, j % 4), k) for k in range(8) for j in range(6)]  # two texts of each class twice
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, class int")).collect()
    assert sorted(r["class"] for r in kept) == list(range(8))
    assert {r["class"]: r.doc_id for r in kept} == {0: 7, 1: None, 2: 7, 3: 7, 4: 100, 5: None, 6: 7, 7: 0}


def test_leaks_are_found_and_clean_texts_left(spark):
    from trackloom.llm.decontaminate import find_leaks

    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    items = [(k, text(30 + k)) for k in range(20)]
    docs = [(k, f"{text(40)} {items[k][1].upper() if k % 2 else items[k][1]} {text(25)}") for k in range(20)]
    changed = items[5][1].split()
    changed[2] = "other"
    docs += [(50, f"{text(40)} {' '.join(changed)} {text(9)}"), (60, text(200)), (61, None), (62, "")]
    got = {(r.id, r.item): (r.start, r.similarity) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == {(k, k) for k in range(20)} | {(50, 5)}
    assert all(got[k, k] == (40, 1.0) for k in range(20)) and 0.8 <= got[50, 5][1] < 1


def every_leak(docs, items) -> dict:
    """(doc, item) -> the greatest similarity of all windows, at least 0.8; weights are counted over all items."""
    parts = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    split = {(k, t): re.findall(WORDS, lower(t)) for k, t in items}
    seen = Counter(s for w in split.values() for s in set(parts(w)))
    weight = {s: math.log1p(len(split) / n) for s, n in seen.items()}
    found = {}
    for doc, text in docs:
        words = re.findall(WORDS, lower(text))
        for (item, _), own in split.items():
            if not set(parts(words)) & set(parts(own)):
                continue
            have, size = Counter(parts(own)), min(len(own), len(words))
            for k in range(len(words) - size + 1):
                shared = Counter(parts(words[k : k + size])) & have
                got = sum(weight[s] * c for s, c in shared.items()) / sum(weight[s] * c for s, c in have.items())
                if got >= 0.8 - 1e-12:
                    found[doc, item] = max(got, found.get((doc, item), 0))
    return found


def awkward_leaks():
    """Items with boilerplate and repetition; documents with truncated items, and with only the rare half of an item."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    common = text(60)
    items = [(k, text(15 + 2 * k)) for k in range(40)] + [(100 + k, f"{text(60)} {common}") for k in range(60)] + [(200, f"{text(9)} {'again and ' * 20}{text(9)}")]
    docs = []
    for k, (_, own) in enumerate(items):
        words = own.split()
        part = words[: len(words) // 2 + 4] if k in range(40, 100) else words[: -(-len(words) * 17 // 20)]
        docs.append((k, f"{text(20 + k)} {' '.join(part)} {text(30)}"))
    return [*docs, (900, text(300)), (901, f"{text(9)} {common} {text(9)}"), (902, "again and " * 60)], items


def test_leaks_are_all_windows_above_the_threshold(spark):
    from trackloom.llm.decontaminate import find_leaks

    docs, items = awkward_leaks()
    want = every_leak(docs, items)
    found = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(want) > 90 and sum(40 <= k < 100 for k, _ in want) > 50
    assert {(r.id, r.item): pytest.approx(r.similarity) for r in found} == want and len(found) == len(want)


def test_leaks_do_not_depend_on_portions(spark):
    """Weights count the whole benchmark, and an item id with several texts is reported once, however the items are dealt out."""
    from trackloom.llm.decontaminate import find_leaks

    docs, items = awkward_leaks()
    items = [*items, *[(k, f"{text} {text}") for k, text in items[:20]]]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, find_leaks(*tables).collect()))
    assert len({r[:2] for r in whole}) == len(whole) > 0
    assert sorted(map(tuple, find_leaks(*tables, portion_words=1500).collect())) == whole


@pytest.mark.parametrize("name", ["op5_warc", "op9_mixing"])
def test_sql(spark, name):
    assert differences(spark, connect(SMALL), q.queries()[name], q.oracle_sql()[name], SMALL) == []


def test_arc_versions_convert():
    from trackloom.llm.warc import arc_file, parse_arc

    for version in ("1", "2"):
        records = [("http://a.example/x y", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n"), ("http://b.example/", "1.2.3.4", "20200102030406", "text/plain", b"")]
        found = [r for r in parse_arc(arc_file(version, "f.arc", records)) if not r.url.startswith("filedesc:")]
        assert [bytes(r.block) for r in found] == [r[4] for r in records]


def test_quality_beats_chance_on_held_out_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = q.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_fingerprints(spark, documents):
    from trackloom.llm.fingerprints import SAMPLES

    got = {r.doc_id: r for r in q.op7_document_fingerprints(spark, SMALL).collect()}
    prints, errors = {}, []
    bag = lambda t: Counter(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w)
    for k, (doc, text) in enumerate(documents):
        after = documents[(k + 1) % len(documents)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[1][:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and (text != edited or r.near_edited == 1)
        own = [r.fingerprint[8 * j : 8 * j + 8] for j in range(SAMPLES)]
        for other, near in ((r.edited_fingerprint, r.near_edited), (got[after[0]].fingerprint, r.near_next)):
            assert near == sum(own[j] == other[8 * j : 8 * j + 8] for j in range(SAMPLES)) / SAMPLES
        a, b = bag(text), bag(edited)
        if a or b:
            errors.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.45


def test_fingerprints_are_as_fine_as_64_samples(spark, documents):
    """Over all pairs of next texts the error is that of 64 samples: at most sqrt(J (1 - J) / 64) each, and never near the old bound."""
    from trackloom.llm.fingerprints import SAMPLES

    got = {r.doc_id: r for r in q.op7_document_fingerprints(spark, SMALL).collect()}
    bag = lambda t: Counter(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w)
    errors, allowed = [], []
    for k, (doc, text) in enumerate(documents):
        after = documents[(k + 1) % len(documents)][1]
        cut = len(text) // 4
        for other, near in ((text[: len(text) - cut] + after[:cut], got[doc].near_edited), (after, got[doc].near_next)):
            a, b = bag(text), bag(other)
            if a or b:
                true = sum((a & b).values()) / sum((a | b).values())
                errors.append(near - true)
                allowed.append(true * (1 - true) / 64)
    assert SAMPLES >= 64 and all(len(r.fingerprint) == 8 * SAMPLES for r in got.values())
    assert max(map(abs, errors)) < 0.25
    assert sum(e * e for e in errors) < 1.3 * sum(allowed)


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    from trackloom.llm.token_files import read_documents, vocabulary, write_tokens
    from trackloom.llm.tables import new_path

    tokenizer, want, start = Tokenizer.from_file(vocabulary()), [], 0
    for doc, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in q.op8_token_id_output(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    folder = write_tokens(spark.createDataFrame(documents, "doc_id bigint, text string"), new_path(spark, "tokens"))
    doc, text = documents[3]
    assert [list(r.ids) for r in read_documents(spark, folder, [doc]).collect()] == [[*tokenizer.encode(text, add_special_tokens=False).ids, 0]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(d: str) -> bool:
        return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (pattern, fits) in kinds.items() for m in re.finditer(pattern, text) if fits(m[0])]


def spans_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii_base_spans(spark, documents):
    got = {r.doc_id: r for r in q.op10_pii(spark, SMALL).collect()}
    for doc, text in documents:
        base, r = base_spans(text), got[doc]
        assert r.base_sha256 == hashlib.sha256(spans_of(base).encode()).hexdigest()
        assert Counter(k for k, _, _ in base) == +Counter({k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")})
        assert {spans_of([x]) for x in base} <= set(r.spans.split(",")) | {""}


def test_pii_base_spans_on_awkward_texts(spark):
    from trackloom.llm.pii import find_pii

    texts = [
        "a@b.c@d.e f@g..h.i x@y-z.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1.1 00001.2.3.4 999999999999.1.1.1", "+1 (2) 3.4-5+67890123 +123456789012345678 +12 34 56 78", "",
        "4111 1111 1111 1111 2 4111-1111-1111-1111 41111111111111114111111111111111 4111  111111111111", "é@b.c 😀a@b.co 😀+1234567890 \n+12345678\n9", "@" * 50 + "a@" * 30 + "b.c", None,
    ]
    alphabet, rng = "12 .-+@a(4)\né", random.Random(10)
    texts += ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(200)]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.id: r.s for r in found.select("id", q.spans_text(F.col("base")).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == spans_of(base_spans(text or "")), (k, text)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, odd, empty):
    """Each operator keeps a row (or a defined answer) for every odd row, and takes an empty table."""
    from trackloom.llm import decontaminate, fingerprints, licenses, mixing, near_duplicates, pii, quality, tables, token_files

    docs = odd.where("false") if empty else odd
    n = docs.count()
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (8, None)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, "no id here five words"), (2, None), (None, "x")], "item_id bigint, text string")
    assert licenses.scan_licenses(docs).count() == n
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == n and all(r.class_id == 3 for r in found if r.id in (3, 4))
    assert near_duplicates.keep_one(docs).count() == (0 if empty else 6)
    assert decontaminate.find_leaks(docs, items).count() == (0 if empty else 1)
    assert quality.score_quality(docs, quality.train(docs, labels)).count() == n
    assert fingerprints.fingerprint_pairs(docs).count() == n
    folder = token_files.write_tokens(docs, tables.new_path(spark, "tokens"))
    assert token_files.read_index(spark, folder).count() == n
    assert mixing.mix(docs).count() == n and mixing.mixed(docs).columns == docs.columns
    assert pii.find_pii(docs).count() == n
