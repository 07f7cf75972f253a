import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from recordloom.llm import byte_bpe, near_duplicates, secret_ledger

FOLDER = "/root/testdata/sf0.001"
FILL = " ".join(f"w{i}" for i in range(40))


def test_stages_by_brute_force(spark):
    """Every stage on its own input, with plain loops."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for _, function in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stage(function(spark, frames[-1], FOLDER)))
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[1:-1])
    assert all(re.search(r"[^\W\d_]", r.text) for r in rows[1].values())
    assert set(rows[0]) - set(rows[1]) == {k for k, r in rows[0].items() if not re.search(r"[^\W\d_]", r.text or "")}

    from test_near_duplicates import brute

    groups = brute([(k, r.text) for k, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {k for k, (_, least) in groups.items() if k == least}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {k for k, r in rows[2].items() if any(x in " ".join(r.text.split()) for x in items)}
    assert not leaks & set(rows[3]) and len(rows[2]) - len(rows[3]) <= len(leaks) + 2
    assert set(rows[4]) == set(rows[3])
    changed = 0
    for k, r in rows[4].items():
        before = rows[3][k].text
        kinds = [re.compile(x.pattern.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))")) if x.kind == "assign" else re.compile(x.pattern) for x in secret_ledger.RULES]
        spans = sorted(m.span() for p, x in zip(kinds, secret_ledger.RULES) for m in p.finditer(before) if len(m[x.group]) >= x.least)
        want, at = "", 0
        for a, b in spans:
            if a >= at:
                want += before[at:a] + "[secret]"
            at = max(at, b)
        want += before[at:]
        assert r.text == want and r.n_chars == (len(want) if spans else rows[3][k].n_chars)
        changed += bool(spans)
    assert changed
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert {k: r.ids for k, r in rows[5].items()} == {k: library.encode_ordinary(r.text) for k, r in rows[4].items()}


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 100


@pytest.mark.parametrize("which", ["odd", "empty", "clashing"])
def test_odd_rows(spark, which, request):
    docs = request.getfixturevalue(which)
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, FOLDER))
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    if which == "empty":
        assert docs.count() == 0
    assert near_duplicates.BANDS
