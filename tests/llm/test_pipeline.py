"""The corpus pipeline stage by stage: each keeps what it must, and the last one's index counts every word piece once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tests.conftest import SMALL


def test_stages(spark):
    import corpus_pipeline
    from trackloom.llm.tables import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == names
        rows.append(docs.count())
    assert rows[0] >= rows[1] >= rows[2] > 0
    index = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r.doc_id for r in index.collect()) == sorted(r.doc_id for r in docs.collect())
    ordered = index.orderBy("start").collect()
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    assert index.where(F.col("n_tokens") < 1).isEmpty()


def test_run_equals_brute_force(spark, tmp_path):
    """The rows of run(): each stage by plain Python or SQL on what the one before kept."""
    import zlib

    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tests.llm.test_operators import WORDS, every_leak, lower, shingles
    from trackloom.llm.mixing import MIX_SQL
    from trackloom.llm.quality import score_quality, train
    from trackloom.llm.token_files import vocabulary

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = score_quality(docs, train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()
    kept = {r.doc_id: r for r in scored if r.score >= 0.5}
    assert len(kept) == len([r for r in scored if r.score >= 0.5]) > 0

    sets = {d: shingles(r.text or "") for d, r in kept.items()}
    words = {d: tuple(re.findall(WORDS, lower(r.text or ""))) for d, r in kept.items()}
    root = {d: d for d in kept}
    linked = [(a, b) for a in kept for b in kept if a < b and (words[a] == words[b] != () or (words[a] == words[b] and kept[a].text == kept[b].text) or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
    while True:
        before = dict(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    kept = {d: r for d, r in kept.items() if root[d] == d}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaking = {d for d, _ in every_leak([(d, r.text or "") for d, r in kept.items()], items)}
    kept = {d: r for d, r in kept.items() if d not in leaking}

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text, r.source) for r in kept.values()], columns=["doc_id", "text", "source"]))
    copies = {d: (taken // size if size else None) for d, size, _, _, taken in con.execute(MIX_SQL).fetchall()}
    tokenizer, want, start = Tokenizer.from_file(vocabulary()), [], 0
    for d in sorted(kept):
        ids = [*tokenizer.encode(kept[d].text or "", add_special_tokens=False).ids, 0]
        for _ in range(copies[d] or 0):
            want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL, f"file:{tmp_path}/tokens").collect())
    assert list((tmp_path / "tokens/shards").glob("*.parquet"))  # the files stay where they were asked for
    assert all(copies[d] is not None for d in kept) and got == sorted(want)


def test_stages_of_odd_rows(spark):
    """Null and repeated ids, empty, null and long texts, null sources, clashing names and empty tables: every stage keeps the columns and goes on."""
    import corpus_pipeline
    from trackloom.llm.tables import written

    long = " ".join(f"w{k % 900}x" for k in range(20_000))
    rows = [(1, "", "a"), (None, None, None), (3, long, "b"), (3, long, "b"), (4, "some plain words of a sentence that is here", None), (None, "no id here and nothing else to say", "a"), (7, "--- ...", "c")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("score", "__score", "id", "__id", "print", "__print", "row", "__row", "copy", "__copy", "size", "of", "rank")})
    odd = odd.withColumn("nested", F.struct(F.lit(1).alias("a b")))
    for table in (odd, odd.where("false")):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SMALL), name)
            assert docs.schema.names == odd.schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
