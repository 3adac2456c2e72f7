"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ren", "sol") for b in ("ter", "ning", "ba", "vo", "lis")]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    rng = np.random.default_rng(7)
    text = lambda n=60: " ".join(rng.choice(VOCAB, n))
    texts = [text() for _ in range(300)]
    leak = text(12)
    texts += [texts[0], " ".join(texts[1].split()[:-1]), f"{text(40)} {leak} {text(5)}", f"{text(1500)} password=abcdefgh1234", "".join(rng.choice(list("#%@XQZ "), 300)), None, ""]
    out = tmp_path_factory.mktemp("sf")
    n = len(texts)
    pd.DataFrame({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]}).to_parquet(out / "documents.parquet")
    pd.DataFrame({"doc_id": range(250), "quality": [1] * 250, "toxic": [0] * 250}).to_parquet(out / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [leak]}).to_parquet(out / "benchmark.parquet")
    return str(out)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    quality, near, leaks, secret, bpe = seen
    assert not {304, 305, 306} & set(quality) and len(quality) >= 300
    assert set(quality) - set(near) == {300, 301}
    assert set(near) - set(leaks) == {302}
    assert set(leaks) == set(secret) == set(bpe)
    assert secret[303]["text"].endswith(" [SECRET]") and secret[303]["n_chars"] == len(secret[303]["text"])
    assert [x for x in secret if secret[x] != leaks[x]] == [303]
    assert list(secret[0]) == ["doc_id", "text", "lang", "source", "n_chars"] and "ids_sha256" in bpe[0]


def _written(folder, rows, labels=(), items=()):
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "findings"]).astype({"doc_id": "Int64", "n_chars": "Int64"} | {c: "string" for c in ("text", "lang", "source", "findings")}).to_parquet(folder / "documents.parquet")
    pd.DataFrame(list(labels), columns=["doc_id", "quality", "toxic"]).astype("Int64").to_parquet(folder / "labels.parquet")
    pd.DataFrame(list(items), columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}).to_parquet(folder / "benchmark.parquet")
    return str(folder)


def test_awkward_tables(spark, tmp_path):
    """Repeated rows, null ids, one id with two texts, a long text and a column that clashes."""
    rng = np.random.default_rng(5)
    text = lambda n=80: " ".join(rng.choice(VOCAB, n))
    a, b, key = text(), text(), text() + " token=abcdefgh12345 end"
    texts = [(1, a), (2, b), (2, a), (3, b), (4, key), (4, key), (None, a), (None, None), (5, ""), (6, text(30_000)), (7, key)]
    rows = [(i, t, "en", "s", None if t is None else len(t), "mine") for i, t in texts]
    sf = _written(tmp_path, rows, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (6, 1, 0), (None, 1, 0)])
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars", "findings"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        if name == "near duplicates":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert {t for _, t in kept} >= {a, b, key} and (3, b) not in kept and (7, key) not in kept and kept.count((4, key)) == 2
    done = docs.collect()
    assert all("abcdefgh12345" not in r.text and r.findings == "mine" for r in done)
    assert sum(r.text.endswith("[SECRET] end") for r in done) == 2


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _written(tmp_path, [])).collect() == []


def test_long_private_key_is_gone(spark):
    """A key of 15,000 lines, a megabyte, in the stage that takes secrets out."""
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 16 + ("\n" + "QUJD" * 16) * 15_000 + "\n-----END RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"before {key} after", "en", "s", 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = corpus_pipeline.secret_scan(spark, docs, "").first()
    assert row.text == "before [SECRET] after" and row.n_chars == len(row.text)
