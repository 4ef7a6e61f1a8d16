"""The pipeline against brute force: stage by stage, each on what the one before it kept."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import bpe, mixing, near_dedup
from tests.llm.test_contracts import LABELS, brute_classes, brute_spans, labelled, near_group, near_rows, water_fill


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = labelled()
    shared = " ".join(f"shared{i}" for i in range(55))
    rows += [(1000 + i, f"{r[1]} {shared} tail{i}", "en", f"s{i % 2}", 1) for i, r in enumerate(rows[:10])]
    rows += [(2000 + r[0], *r[1:]) for r in near_rows()]
    rows += [(None, None, None, None, None), (5000, "", "en", "s", 0)]
    make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = docs.collect()
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        work = corpus_pipeline.Workspace(spark, "stage-test")
        docs = work.table(stage(spark, docs, folder), name)
        tables[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    toxic = {r.doc_id for r in given if r.text and "zorgak" in r.text.lower()}
    kept = {r.doc_id for r in tables["toxicity"]}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len({r.doc_id for r in given} - toxic - kept) <= 0.05 * len(given)

    before = [(r.doc_id, r.text) for r in tables["toxicity"]]
    heads = {c for _, c in brute_classes(before)}
    assert Counter(r.doc_id for r in tables["near_dedup"]) == Counter(heads)

    marked, _ = brute_spans([(r.doc_id, r.text) for r in tables["near_dedup"]])
    cut = {r.doc_id: r for r in tables["suffix_dedup"]}
    assert len(cut) == len(tables["near_dedup"]) and marked
    for r in tables["near_dedup"]:
        words = [w for p, w in enumerate((r.text or "").split()) if ((r.doc_id, r.text or ""), p) not in marked]
        assert (cut[r.doc_id].text or "").split() == words

    sizes, taken = Counter(), Counter()
    for r in tables["suffix_dedup"]:
        sizes[r.source] += len((r.text or "").split())
    for r in tables["mixing"]:
        taken[r.source] += len((r.text or "").split())
    largest = max(len((r.text or "").split()) for r in tables["suffix_dedup"])
    assert all(abs(taken[s] - t) <= largest for s, t in water_fill(sizes).items())
    assert max(Counter(r.doc_id for r in tables["mixing"]).values()) <= mixing.MAX_REPEAT

    own = bpe.codec(bpe.public_tokenizers.path(bpe.RANK_FILE))
    want = Counter()
    for r in tables["mixing"]:
        [(ids, decimal)] = own.encode([r.text or ""])
        assert own.replay.decode(ids) == (r.text or "").encode()
        want[(r.doc_id, len(ids), hashlib.sha256(decimal.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in tables["byte_bpe"]) == want
    assert all(len(r.ids or []) == r.n_tokens for r in tables["byte_bpe"])


def test_near_dedup_compares_few_pairs_of_a_large_group(spark, make_docs, monkeypatch):
    signed, plausible, compared = near_dedup.candidate_bands, near_dedup.plausible, []

    def counted(pairs, samples):
        compared.append(pairs.count())
        return plausible(pairs, samples)

    monkeypatch.setattr(near_dedup, "candidate_bands", lambda *given: signed(*given).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dedup, "plausible", counted)
    kept = corpus_pipeline.near_dedup(spark, make_docs(near_group(120)), "").collect()
    assert [r.doc_id for r in kept] == [0] and sum(compared) <= 6 * 120, compared


def test_run_on_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
