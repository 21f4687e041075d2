"""Every operator on nulls, empty and very long texts, ties, repeated rows, an
empty table, and extra columns whose names clash with the operators' own."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tierwise.llm import (bpe, fingerprint, language, line_dedup, minhash, packing, pitman_yor, repetition, token_cache, toxicity)
from tierwise.llm.common import shared_path

PROSE = "The quick brown fox jumps over the lazy dog while the cat looks on.\n"
ROWS = [
    (1, PROSE * 3, "en"), (2, None, None), (3, "", "en"), (4, "日本語のテキスト 😀 ́", "ja"), (5, "####", None), (6, PROSE * 3, "en"),
    (6, PROSE * 3, "en"), (7, "x" * 300_000, "en"), (8, "word " * 30_000, None), (9, "\n\n \t", "en"), (None, PROSE, "en"), (None, None, None),
]
CLASHES = ["doc", "key", "line", "pos", "h1", "digest", "row", "body", "score", "n_tokens", "n_words", "signature", "bands", "bucket", "place",
           "piece", "length", "shard", "number", "toxic", "id", "train", "chunk", "block", "w", "n", "fingerprint", "kept", "component_id"]


def run_all(spark, docs, labels):
    cache = token_cache.TokenCache(spark, shared_path(spark, "test-cache"))
    model = toxicity.learn_toxicity(docs, labels)
    return {
        "toxicity": toxicity.score_toxicity(docs, model),
        "tokens": token_cache.count_tokens(docs, cache, public_tokenizers.path("piece_bpe_32k.model")),
        "rules": repetition.repetition_rules(docs),
        "language": language.identify_languages(docs, language.learn_languages(docs)),
        "lm": pitman_yor.score_texts(docs, pitman_yor.training_rows()),
        "near": minhash.near_duplicates(docs),
        "bpe": bpe.round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "pack": packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "next": fingerprint.compare_with_next(docs),
        "lines": line_dedup.dedup_lines(docs, min_docs=2),
    }


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def found(spark, make):
    docs = make(ROWS).withColumns({c: F.lit("clash") for c in CLASHES})
    return {k: df.collect() for k, df in run_all(spark, docs, labels_of(spark, [(1, 1, 0), (4, 0, 1), (None, None, None), (6, 1, None)])).items()}


@pytest.mark.parametrize("name", ["toxicity", "tokens", "rules", "language", "lm", "near", "bpe", "next", "lines"])
def test_one_row_per_row(found, name):
    ids = sorted((r.doc_id is None, r.doc_id) for r in found[name])
    assert ids == sorted((r[0] is None, r[0]) for r in ROWS)


def one(rows, doc_id):
    return next(r for r in rows if r.doc_id == doc_id)


def test_null_and_empty_texts(found):
    none = hashlib.sha256(b"").hexdigest()
    for i in (2, 3):
        assert one(found["tokens"], i).n_tokens == 0 and one(found["tokens"], i).n_bytes == 0
        assert one(found["rules"], i).n_words == 0 and one(found["rules"], i).base_failed
        assert one(found["language"], i).lang_pred == "und" and one(found["language"], i).rejected
        assert one(found["lm"], i).n_tokens == 1
        assert one(found["near"], i).n_shingles == 0 and one(found["near"], i).component_id == i and one(found["near"], i).kept
        assert one(found["bpe"], i).ids_sha256 == none == one(found["bpe"], i).decoded_sha256
        assert one(found["next"], i).n_chars == 0 and set(one(found["next"], i).fingerprint) == {"0"}
        assert one(found["lines"], i).n_lines == 1 and one(found["lines"], i).kept_text == ""
        assert [(r.length, r.piece) for r in found["pack"] if r.doc_id == i] == [(1, 0)]
    assert one(found["language"], 5).lang_pred == "und"
    assert one(found["language"], 9).lang_pred == "und"


def test_repeated_rows_and_null_ids(found):
    near = {(r.doc_id, r.component_id, r.kept) for r in found["near"]}
    assert (1, 1, True) in near and (6, 1, False) in near and (None, None, True) in near
    assert len([r for r in found["pack"] if r.doc_id == 6]) == 2
    assert len({r.score for r in found["lm"] if r.doc_id in (1, 6)}) == 1
    assert len({r.fingerprint for r in found["next"] if r.doc_id in (1, 6)}) == 1
    lines = [r for r in found["lines"] if r.doc_id == 6]
    assert len(lines) == 2 and all(r.n_dropped == 3 and r.n_lines == 4 for r in lines)


def test_long_texts_are_taken_whole(found):
    assert one(found["tokens"], 7).n_bytes == 300_000 and one(found["rules"], 8).n_words == 30_000
    assert one(found["rules"], 8).longest_repeat == 29_999 and not one(found["rules"], 8).kept
    assert one(found["next"], 7).n_chars == 300_000
    pieces = sorted((r.piece, r.start, r.length) for r in found["pack"] if r.doc_id == 8)
    assert sum(p[2] for p in pieces) == one(found["bpe"], 8).n_tokens + 1 and all(p[2] == 2048 for p in pieces[1:])


def test_sequences_are_gapless(found):
    at = {}
    for r in sorted(found["pack"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def test_empty_table(spark, make):
    docs = make([])
    for name, df in run_all(spark, docs, labels_of(spark, [])).items():
        assert df.collect() == [], name


def test_pipeline_stages_on_edges(spark, make):
    plain = make(ROWS)
    clashing = plain.withColumns({c: F.lit("clash") for c in [*CLASHES, "gone_id", "node", "carried", "a.b"]})
    folder = shared_path(spark, "test-edges")
    labels_of(spark, [(1, 1, 0), (4, 0, 1)]).write.parquet(f"{folder}/labels.parquet")
    by_stage = {}
    for docs in (plain, clashing, make([])):
        for name, stage in corpus_pipeline.STAGES:  # each on the whole table
            now = stage(spark, docs, folder)
            if name != "packing":
                assert now.columns == docs.columns, name
            rows = now.collect()
            by_stage.setdefault(name, []).append(sorted((str(r.doc_id), r.text or "") if name != "packing" else (str(r.doc_id), r.length) for r in rows))
    for name, (of_plain, of_clashing, of_none) in by_stage.items():
        assert of_plain == of_clashing and not of_none, name
    assert all(found[0] for name, found in by_stage.items() if name not in ("toxicity", "language_id"))


A = "one two three four five six seven eight nine ten eleven twelve"
B = "completely other words stand here and are like nothing else at all"


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(3, A), (6, A), (6, B)], [(3, A), (6, B)]),  # an id's other text is like nothing else
        ([(1, A)] * 3, [(1, A)]),  # copies of one id
        ([(2, B), (1, A), (1, A), (5, A), (1, B)], [(1, A), (1, B)]),
        ([(9, None), (9, ""), (10, ""), (10, "")], [(9, None), (10, "")]),
        ([(None, A), (4, A), (None, B)], [(None, A), (None, B)]),
        ([(7, A + " thirteen"), (8, A), (8, B)], [(7, A + " thirteen"), (8, B)]),
    ],
)
def test_near_dedup_drops_rows_not_ids(spark, make, rows, kept):
    found = corpus_pipeline.near_dedup(spark, make(rows), "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in found) == sorted((str(i), t or "") for i, t in kept)


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, master):
            self.of = {"spark.master": master}

        def get(self, key, default=None):
            return self.of.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert shared_path(Session("local[8]"), "x").startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_path(Session(master), "x")
