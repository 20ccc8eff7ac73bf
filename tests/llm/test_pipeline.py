from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from halyard.llm import mixing, pieces, queries
from halyard.llm.shared import stored
from tests.llm.test_ops import classes_by_matrix, classes_of, docs, odd, plain_ids, plain_score, repeats, shingles, template_group, water


def plain_mix(spark, rows, weights=(5, 2, 1), block=64, most=3, seed=17):
    """How often each row (doc_id, text, source) is in the mix: blocks in a line a source, drawn in order. One shard a source."""
    key = "doc_id long, text string, source string"
    hashed = spark.createDataFrame(rows, key).select("doc_id", "source", F.xxhash64("doc_id", F.lit(seed + 1)).alias("h"), F.xxhash64("text", F.lit(seed)).alias("tie"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 3)), F.lit(1 << 20)) / float(1 << 20)).alias("chance"), "text").collect()
    sources = sorted({r.source for r in hashed}, key=lambda x: (x is None, x))
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    totals = [sum(size(r) for r in hashed if r.source == s) for s in sources]
    targets = water(totals, [weights[k % 3] for k in range(len(sources))])
    quotas = mixing.sainte_lague(np.array(targets), round(sum(targets) / block)).tolist()
    copies = {}
    for place, (source, total, quota) in enumerate(zip(sources, totals, quotas, strict=True)):
        words = min(min(quota, -(-most * total // block)) * block, most * total)
        passes, rest = divmod(words, total) if total else (0, 0)
        line, at = [], 0
        for r in sorted((r for r in hashed if r.source == source), key=lambda r: (r.h, r.doc_id, r.tie)):
            line.append((at, at + size(r), r))
            at += size(r)
        n = -(-total // block)
        order = spark.range(n).select("id", F.xxhash64(F.lit(place).cast("long"), F.lit(0).cast("long"), "id", F.lit(seed + 2)).alias("h")).collect() if n else []
        taken = {r.doc_id: passes * size(r) for _, _, r in line}
        for b in sorted(order, key=lambda b: (b.h, b.id)):
            for begin, end, r in line:
                some = min(min(end, (b.id + 1) * block) - max(begin, b.id * block), rest)
                if some > 0:
                    taken[r.doc_id] += some
                    rest -= some
        for _, _, r in line:
            share = taken[r.doc_id] / size(r) if size(r) else 1.0
            copies[r.doc_id] = int(share) + (r.chance < share - int(share))
    return copies


def test_stages(spark, tiny):
    """Every stage on all that came before, its decisions against brute force."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "source_mix", "pieces"]

    clean = stored(steps["toxicity"](spark, docs, tiny), "t")
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and all(k in kept for k, t in labels.items() if not t)

    single = stored(steps["near_duplicates"](spark, clean, tiny), "n")
    rows = clean.orderBy("doc_id").collect()
    roots = classes_of([shingles(r.text) for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k].doc_id for k in roots})

    cut = stored(steps["repeated_strings"](spark, single, tiny), "r")
    rows = single.orderBy("doc_id").collect()
    data = [r.text.encode() for r in rows]
    want = [bytes(np.frombuffer(t, np.uint8)[~m]).decode("utf-8", "ignore") for t, m in zip(data, repeats(data), strict=True)]
    assert [r.text for r in cut.orderBy("doc_id").collect()] == want and cut.columns == docs.columns

    mixed = stored(steps["source_mix"](spark, cut, tiny), "m")
    assert mixed.columns == docs.columns and mixed.join(cut, "doc_id", "left_anti").count() == 0
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = plain_mix(spark, [(r.doc_id, r.text, r.source) for r in cut.collect()])
    assert got == {k: n for k, n in want.items() if n} and max(got.values()) <= 3

    ids = steps["pieces"](spark, mixed, tiny).collect()
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    keyed = [(r.doc_id, r.text, [r.first, r.second, r.third]) for r in mixed.select("doc_id", "text", F.xxhash64("doc_id").alias("first"), F.xxhash64("doc_id", F.lit(1)).alias("second"), F.xxhash64("doc_id", F.lit(2)).alias("third")).distinct().collect()]
    plain = {k: [plain_ids(model, text, key % 2**64) for key in keys[: got[k]]] for k, text, keys in keyed}
    found = {}
    for r in ids:
        found.setdefault(r.doc_id, []).append(r.ids)
        assert r.n_pieces == len(r.ids)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in plain.items()}
    texts = {k: text for k, text, _ in keyed}
    assert all(pieces.decode(model, np.array(r.ids)) == texts[r.doc_id] for r in ids)


def test_copies_of_a_document_differ(spark, tiny):
    """Three copies of a text: three segmentations, all lossless, the first that of the text alone; the table's order does not
    matter."""
    text = "A considerable number of segmentations are conceivable for internationalization. " * 5
    df = docs(spark, [text, text, "short"]).filter("doc_id <> 1")
    three = df.union(df.filter("doc_id = 0")).union(df.filter("doc_id = 0"))
    rows = corpus_pipeline.pieces(spark, three.repartition(3), tiny).collect()
    own = [tuple(r.ids) for r in rows if r.doc_id == 0]
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    assert len(rows) == 4 and len(set(own)) == 3 and {pieces.decode(model, np.array(i)) for i in own} == {text}
    alone = [tuple(r.ids) for r in corpus_pipeline.pieces(spark, df, tiny).collect() if r.doc_id == 0]
    assert alone[0] in own and sorted(own) == sorted(tuple(r.ids) for r in corpus_pipeline.pieces(spark, three.coalesce(1), tiny).collect() if r.doc_id == 0)


def test_toxicity_stage_rejects_by_score(spark, tiny):
    """What goes is what the plain matcher scores at 0.5 or more."""
    from halyard.llm.toxicity import fit_lexicon

    larger = tiny.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    lexicon = fit_lexicon(docs, spark.read.parquet(f"{larger}/labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, larger).collect()}
    rows = docs.collect()
    assert kept == {r.doc_id for r in rows if plain_score(lexicon, r.text) < 0.5} and 0 < len(kept) < len(rows)


def test_run(spark, tiny):
    """The stages one after another: nothing comes back that an earlier one took away."""
    out = corpus_pipeline.run(spark, tiny)
    rows = out.collect()
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.toxicity(spark, spark.read.parquet(f"{tiny}/documents.parquet"), tiny), tiny).collect()}
    assert out.columns == ["doc_id", "ids", "n_pieces"] and rows and {r.doc_id for r in rows} <= left


def test_odd_tables(spark, tiny):
    df = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, tiny)
            assert out.columns == df.columns, name
            assert out.count() <= 3 * df.count()
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, tiny).collect()} >= {0, None}
    ids = corpus_pipeline.pieces(spark, df, tiny)
    assert ids.count() == df.count() and corpus_pipeline.pieces(spark, df.limit(0), tiny).count() == 0
    assert {r.n_pieces for r in ids.join(df.filter("text is null").select("doc_id"), "doc_id").collect()} == {0}
    back = pieces.decode_documents(ids, queries.tokenizer_path("piece_bpe_32k.model"))
    assert sorted((repr(r.doc_id), repr(r.text)) for r in back.collect()) == sorted((repr(r.doc_id), repr(r.text)) for r in df.collect())


def test_template_group_keeps_one_of_each_class(spark, tiny):
    """Thousands of texts of one template with near copies among them."""
    texts = template_group()
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts), tiny)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_by_matrix(texts)))
