import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from llm.tables import CLASH, SCHEMA, prose
from llm.test_leaks import plain as hits
from llm.test_near import brute, changed
from llm.test_quality_rules import plain as base
from turnout.llm import pii, rules

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def folder(spark, tmp_path, rows, items):
    full = [(d, t, "en", "s", len(t) if t is not None else None, *CLASH) for d, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_equal_plain_versions(spark, tmp_path):
    own = random.Random(2)
    items = [(n, prose(50 + n, 25, "q")) for n in range(5)]
    rows = [(n, prose(100 + n, own.randint(12, 200))) for n in range(80)]
    rows += [(200 + n, changed(rows[n][1], n, 1)) for n in range(0, 40, 4)] + [(300, rows[3][1]), (300, rows[3][1]), (301, None), (302, ""), (303, "too short")]
    rows += [(400 + n, prose(700 + n, 40) + " " + items[n][1]) for n in range(5)]
    rows += [(500, prose(800, 30) + " mail me at jane.doe@mail.example.org or +1 (555) 123-4567"), (501, "a b c d e " * 40)]
    sf = folder(spark, tmp_path, rows, items)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), list(rows)
    columns = docs.columns
    for n, (_, stage) in enumerate(pipeline.STAGES):
        if n == 0:
            far = {r["doc_id"] for r in rules.quality(docs).filter("NOT base_failed AND NOT kept").collect()}
            kept = [r for r in kept if not base(r[1])[-1] and r[0] not in far]
            assert len(far) <= 2
        elif n == 1:
            roots = brute(kept)
            kept = sorted({r for r in kept if roots[r[0]][1] == r[0]})
        elif n == 2:
            bad = {h[0] for h in hits(kept, items) if h[-1]}
            assert bad >= {400, 401, 402, 403, 404} & {r[0] for r in kept}
            kept = [r for r in kept if r[0] not in bad]
        elif n == 3:
            kept = [(d, pii.masked(t, pii.spans(t))) for d, t in kept]
            assert dict(kept)[500].endswith("mail me at [EMAIL] or [PHONE]")
        docs = stage(spark, docs, sf)
        if n < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs.write.parquet(f"{sf}/stage-{n}")
            docs = spark.read.parquet(f"{sf}/stage-{n}")
            assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((d, t, len(t)) for d, t in kept)
    want = sorted((d, len(i), i) for d, t in kept for i in [LIBRARY.encode(t, add_special_tokens=False).ids])
    assert sorted(map(tuple, docs.collect())) == want
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == want


def test_empty_documents(spark, tmp_path):
    assert pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0
