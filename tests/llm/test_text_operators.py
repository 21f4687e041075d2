"""Operators on single texts, against brute force and the tokenizers' libraries."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tierwise.llm import fingerprint, queries
from tierwise.llm.bpe import ByteBPE
from tierwise.llm.fingerprint import Walk, band_keys, likeness, sampled_steps, similar_documents
from tierwise.llm.packing import best_fit_decreasing
from tierwise.llm.repetition import COLUMNS, MIN_REPEAT, rules
from tierwise.llm.token_cache import TokenCache, count_tokens, tokenizer_version
from tierwise.llm.common import mix, shared_path
from tierwise.llm.toxicity import maximal_segments

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# -------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def coders():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {
        "tiktoken": (ByteBPE(P.path("byte_bpe_50k.tiktoken")), plain.encode_ordinary),
        "json": (ByteBPE(P.path("byte_bpe_50k.json")), lambda t: Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids),
    }


PARTS = [*"aaasstmdrevl'' ''  \n\t\x0b\x85  éß日本٣½²#$..,0159\U0001F600́\x1c<|>", "<|endoftext|>", "'re", "'ll", " don't "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=6))
def test_ids_are_tiktokens(coders, some):
    ours, theirs = coders["tiktoken"]
    coded = ours.encode(some)
    for k, t in enumerate(some):
        assert coded.text(k).tolist() == theirs(t)
        assert ours.decode(coded.text(k))[0] == t.encode()


def test_ids_are_the_json_librarys(coders):
    ours, theirs = coders["json"]
    draw = random.Random(3)
    some = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 50))) for _ in range(40)] + ["", "a" * 3000, "=-" * 200, " " * 500]
    coded = ours.encode(some)
    for k, t in enumerate(some):
        assert coded.text(k).tolist() == theirs(t), t


def test_offsets_align_ids_with_text(coders):
    ours, _ = coders["tiktoken"]
    text = "It's 12 o'clock,\n  and all's well…"
    coded = ours.encode([text])
    cuts = [*coded.starts.tolist(), len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert ours.decode(coded.ids[coded.before[k] : coded.before[k + 1]])[0] == text[a:b].encode()


def test_op7_round_trips(spark, texts, coders):
    _, theirs = coders["tiktoken"]
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = theirs(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---------------------------------------------------------------- counting


def test_op2_counts_are_sentencepieces(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = queries.op2_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_cache_encodes_each_text_once(spark, make):
    file = P.path("piece_bpe_32k.model")
    cache = TokenCache(spark, shared_path(spark, "test-counts"))
    first = make([(1, "one two"), (2, "one two"), (3, "three")])
    assert {r.doc_id: r.n_tokens for r in count_tokens(first, cache, file).collect()}[1] > 0
    held = lambda: spark.read.parquet(cache.path).count()
    assert held() == 2
    count_tokens(make([(4, "three"), (5, "four")]), cache, file).collect()
    assert held() == 3
    assert tokenizer_version(file) != tokenizer_version(P.path("byte_bpe_50k.json"))


def test_span_hashes_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    import tierwise.llm.common as module

    buf = np.frombuffer(bytes(range(33, 120)) * 20, np.uint8)
    start, end = np.arange(0, 1500, 50), np.arange(0, 1500, 50) + np.arange(30) * 7
    end = np.maximum.accumulate(end)
    whole = module.SpanHash(buf)(start, end)
    for block in (1, 7, 64, 10_000):
        monkeypatch.setattr(module, "HASH_BYTES", block)
        assert (module.span_hashes(buf, start, end) == whole).all()


def test_repeated_rows_are_encoded_once(spark, make):
    """Equal rows, equal texts of other ids and of null ids: one row of the cache for a text."""
    file = P.path("piece_bpe_32k.model")
    cache = TokenCache(spark, shared_path(spark, "test-counts"))
    rows = [(1, "the same text")] * 1000 + [(2, "another")] + [(None, "the same text")] * 500 + [(k, "the same text") for k in range(500)]
    found = count_tokens(make(rows).repartition(7), cache, file).collect()
    assert len(found) == len(rows) and len({r.n_tokens for r in found if r.n_bytes == 13}) == 1
    held = lambda: spark.read.parquet(cache.path).count()
    assert held() == 2
    more = [*rows, *[(9, "and a new one")] * 1000]
    assert len(count_tokens(make(more), cache, file).collect()) == len(more) and held() == 3


def test_a_full_cache_spares_every_text_the_shuffle(spark, make, monkeypatch):
    import tierwise.llm.token_cache as module

    file = P.path("piece_bpe_32k.model")
    cache = TokenCache(spark, shared_path(spark, "test-counts"))
    docs = make([(k, f"text {k}") for k in range(300)])
    count_tokens(docs, cache, file).collect()
    rows = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").alias("body"))
    none = module._texts_of(rows, rows.select("digest").limit(0))
    few = module._texts_of(rows, rows.where("body IN ('text 7', 'text 8')").select("digest"))
    assert none.collect() == [] and sorted(r.body for r in few.collect()) == ["text 7", "text 8"]
    monkeypatch.setattr(module, "MARKS", 64)  # bits that many digests share: the exact join decides
    few = module._texts_of(rows, rows.where("body IN ('text 7', 'text 8')").select("digest"))
    assert sorted(r.body for r in few.collect()) == ["text 7", "text 8"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("getbit")  # from the top down


# ----------------------------------------------------------------- packing


def naive_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in bins if r >= n]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else capacity) - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = best_fit_decreasing(histogram, capacity)
    length = np.array([n for n, k in histogram.items() for _ in range(k)])
    bins, offsets = plan.place(length, np.array([i for k in histogram.values() for i in range(k)]))
    used = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), length.tolist())):
        assert used.get(b, 0) == o
        used[b] = o + n
    assert sorted(capacity - x for x in used.values()) == naive_bins(lengths, capacity) and len(used) == plan.n_bins


def test_op8_packs_the_librarys_ids(spark, texts):
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, at = queries.op8_best_fit_packing(spark, SF).collect(), {}
    pieces = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        pieces.setdefault(r.doc_id, []).append(r)
    assert max(at.values()) <= 2048
    assert len(at) == len(naive_bins([r.length for r in rows], 2048))
    for doc, found in pieces.items():
        ids, start = [*coder.encode(texts[doc], add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, start) and (len(found) == 1 or k == 0 or r.length == 2048)
            start += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : start], "<u4").tobytes())
        assert start == len(ids)
    assert pieces.keys() == texts.keys()


# -------------------------------------------------------------- repetition


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, longest = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    repeat = {i + k for i in range(n) if longest[i] >= 3 for k in range(3)}
    covered = {i + k for i in range(n) if longest[i] >= MIN_REPEAT for k in range(longest[i])}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    found = {}
    for i in range(n):
        for k in range(MIN_REPEAT, n - i + 1):
            found.setdefault(tuple(w[i : i + k]), []).append(i)
    maximal = 0
    for words, at in found.items():
        before = {w[i - 1] if i else None for i in at}
        after = {w[i + len(words)] if i + len(words) < n else ("end", i) for i in at}
        maximal += len(at) > 1 and len(before) > 1 and len(after) > 1
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(covered),
            max((k for k in longest if k >= MIN_REPEAT), default=0), maximal]


words = st.sampled_from(["a ", "b ", "a\n", "c  ", "é#\t", "日本 ", "$ "])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(words, max_size=45).map("".join).flatmap(lambda t: st.sampled_from([t, t + t, t + "x " + t])), min_size=1, max_size=4))
def test_rules_by_brute_force(some):
    found = rules(pa.array(some, pa.string()))
    for k, t in enumerate(some):
        assert [int(found[c][k]) for c in COLUMNS] == brute_rules(t)


def test_op3_verdicts(spark, texts):
    for r in queries.op3_repetition_rules(spark, SF).collect():
        if r.n_words <= 60:
            assert [r[c] for c in COLUMNS[:5]] == brute_rules(texts[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_repeated_half_is_rejected_and_prose_kept(spark, make):
    draw = random.Random(1)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    copied = prose(80)
    docs = make([(1, prose(300)), (2, f"{copied} {prose(200)} {copied}"), (3, prose(20)), (4, prose(30) * 20)])
    from tierwise.llm.repetition import repetition_rules

    assert {r.doc_id: r.kept for r in repetition_rules(docs).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_long_passage_that_stands_twice_is_rejected(spark, make):
    draw = random.Random(2)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short = prose(2_500), prose(45)
    docs = make([(1, f"{long} {prose(15_000)} {long}"), (2, f"{short} {prose(900)} {short}"), (3, prose(20_000))])
    from tierwise.llm.repetition import MAX_COVERED, repetition_rules

    found = {r.doc_id: r for r in repetition_rules(docs).collect()}
    assert found[1].longest_repeat == 2_500 and found[1].covered_words < MAX_COVERED * found[1].n_words and not found[1].base_failed
    assert {i: r.kept for i, r in found.items()} == {1: False, 2: True, 3: True}


# ------------------------------------------------------------ fingerprints


def slow_fingerprint(text):
    """Step by step: write the character down, move on where the shared bit is 1, then read the sampled steps."""
    word = lambda x: int(mix(np.array([x], np.uint64))[0])
    seed, written, at, step, points = int(fingerprint.SEED), [], 0, 0, [ord(c) for c in text]
    classes = {c: word(c) & (fingerprint.CLASSES - 1) for c in set(points)}
    while at < len(points):
        written.append(at)
        at += word((classes[points[at]] * fingerprint.PERIOD + step % fingerprint.PERIOD) ^ seed) >> 63
        step += 1
    out = []
    for slot in range(fingerprint.SLOTS):
        if not points:
            out.append(0)
            continue
        at = written[max(s for s in sampled_steps()[:, slot].tolist() if s < len(written))]
        after = points[at + 1] if at + 1 < len(points) else 0
        out.append(word(((word(points[at] << 32 | after) ^ seed) + slot) % (1 << 64)) % 255 + 1)
    return bytes(out).hex()


def test_walks_by_brute_force():
    draw = random.Random(3)
    for n in (0, 1, 2, 3, 10, 50, 400, 3000):
        text = "".join(draw.choices("abcdefghij \n日é😀", k=n))
        assert Walk(text).fingerprint().tobytes().hex() == slow_fingerprint(text)
        other = "".join(draw.choices("xyz", k=n))
        assert Walk(text).edited(other).fingerprint().tobytes().hex() == slow_fingerprint(text[: n - n // 4] + other[: n // 4])


def brute_groups(prints, least=0.75):
    """Links of pairs that share a band and are alike, followed by hand."""
    arrays = {i: np.frombuffer(bytes.fromhex(f), np.uint8) for i, f in prints.items()}
    buckets = defaultdict(list)
    for i, a in arrays.items():
        for key in band_keys(a).tolist() or ["empty"]:
            buckets[key].append(i)
    label = {i: i for i in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for members in buckets.values():
        for a, b in itertools.combinations(members, 2):
            if top(a) != top(b) and likeness(arrays[a], arrays[b]) >= least:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in prints}


def test_op9_groups_by_brute_force(spark):
    rows = queries.op9_fingerprints(spark, SF).collect()
    assert {r.doc_id: r.group for r in rows} == brute_groups({r.doc_id: r.fingerprint for r in rows})
    assert sum(r.group != r.doc_id for r in rows) > 5


def test_a_hot_id_is_cut(spark, make):
    """A third of the rows on one id: dealt to several partitions, and neighbours in order of (id, hash) all the same."""
    rows = [(7, f"text {k} of the hot id") for k in range(600)] + [(k, f"cold text {k}") for k in range(20, 1220)] + [(None, "before all")] * 3
    docs = make(rows).repartition(6)
    found = fingerprint.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    expected = []
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]]):
        expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(expected)
    spread = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("task")).repartitionByRange(8, "doc_id", "hash", "task")
    sizes = [r["count"] for r in spark.createDataFrame(spread.rdd.mapPartitions(lambda x: [(sum(1 for _ in x),)]), "count long").collect()]
    assert max(sizes) < 400


def test_op9_edits_and_likeness(spark, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in queries.op9_fingerprints(spark, SF).collect()}
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        t, other, r = texts[i], texts[ids[(k + 1) % len(ids)]], rows[i]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == Walk(t).fingerprint().tobytes().hex()
        assert r.edited_fingerprint == Walk(edited).fingerprint().tobytes().hex()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    apart = [r for r in rows.values() if r.near_edited > r.near_next + 0.2]
    assert len(apart) > 0.97 * len(rows)


def test_likeness_falls_with_edits():
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefghij ") for _ in range(4000))
    like = []
    for edits in (0, 1, 10, 100):
        changed = list(text)
        for _ in range(edits):
            at = draw.randrange(len(changed))
            changed[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "yz"])
        like.append(likeness(Walk(text).fingerprint(), Walk("".join(changed)).fingerprint()))
    assert like[0] == 1 and min(like[1:3]) > 0.8 and like[3] < min(like[:3])  # a single edit may fall between samples


def test_changes_at_the_end_of_long_texts_are_seen():
    draw, seen, texts = random.Random(6), 0, 150
    for _ in range(texts):
        n = int(20_000 * 10 ** draw.random())
        text = "".join(draw.choices("abcdefghij ", k=n))
        changed = text[: n - n // 100] + "".join(draw.choices("klmnopqrst", k=n // 100))
        seen += (Walk(text).fingerprint() != Walk(changed).fingerprint()).any()
    # a slot samples the last hundredth of the steps with a chance of 1%, any of 128 with 72%
    assert 0.6 * texts < seen < 0.84 * texts


def test_every_step_is_as_likely_to_be_sampled():
    steps, share = sampled_steps(), np.zeros(20)
    lengths = np.unique(np.geomspace(1e3, 1e9, 4000).astype(np.int64))
    for n in lengths:
        share += np.bincount(np.where(steps < n, steps, 0).max(axis=0) * 20 // n, minlength=20) / 128 / len(lengths)
    assert share == pytest.approx(np.full(20, 0.05), abs=0.012)


def test_similar_documents(spark, make):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefghij ") for _ in range(1500)) for _ in range(4)]
    docs = make([(k, t) for k, t in enumerate(base)] + [(10 + k, t[:700] + "X" + t[700:]) for k, t in enumerate(base)] + [(20, base[0]), (None, base[1]), (30, "")])
    found = {r.doc_id: r.group for r in similar_documents(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 2, 13: 3, 20: 0, None: None, 30: 30}


@pytest.mark.parametrize("block", [1_000, 2])
def test_alike_members_meet_where_a_centre_is_unlike_both(spark, make, monkeypatch, block):
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    draw = random.Random(12)
    text = "".join(draw.choice("abcdefghij ") for _ in range(3000))

    def edited(edits):
        changed = list(text)
        for at in draw.sample(range(3000), edits):
            changed[at] = "X"
        return "".join(changed)

    a, b = Walk(text).fingerprint(), Walk(twin := text[:2800] + "Y" + text[2801:]).fingerprint()
    assert likeness(a, b) >= 0.75
    shared, centres = set(band_keys(a)) & set(band_keys(b)), []
    while shared:  # every band that the two share has a smaller id that is unlike both
        other = Walk(t := edited(draw.randint(20, 80))).fingerprint()
        if max(likeness(other, a), likeness(other, b), *(likeness(other, Walk(c).fingerprint()) for c in centres)) < 0.75 and shared & set(band_keys(other)):
            centres.append(t)
            shared -= set(band_keys(other))
    docs = make([*enumerate(centres), (1000, text), (1001, twin)])
    found = {r.doc_id: r.group for r in fingerprint.similar_documents(docs).collect()}
    assert found == {**{k: k for k in range(len(centres))}, 1000: 1000, 1001: 1000}


# --------------------------------------------------------------- segments


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((round(total[b] - total[a], 9), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-50, 30).filter(bool).map(lambda k: k + 0.137 * (k % 7)), max_size=18))
def test_segments_are_all_maximal_ones(scores):
    found = maximal_segments(scores)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    assert [s for *_, s in found] == pytest.approx([total[b] - total[a] for a, b, _ in found])
    assert [round(s, 6) for *_, s in found] == [round(total[b] - total[a], 6) for a, b in brute_segments(scores)]


def test_toxicity_takes_texts_in_small_pieces(make):
    from tierwise.llm import toxicity
    from tierwise.llm.common import SLICE_BYTES, over_texts

    texts = ["ab " * 40_000] * 20 + ["c" * (toxicity.PIECE_BYTES + 1)] + ["d"] * 5
    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    list(over_texts(lambda part: sizes.append([len(x) for x in part.column("text").to_pylist()]), limit=toxicity.PIECE_BYTES)([batch]))
    assert [n for part in sizes for n in part] == [len(x) for x in texts]
    assert toxicity.PIECE_BYTES <= SLICE_BYTES // 4 and all(sum(part) <= toxicity.PIECE_BYTES or len(part) == 1 for part in sizes)


def test_learning_toxicity_caches_nothing(spark, make, monkeypatch):
    from tierwise.llm import toxicity

    cached = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.cache", lambda self: cached.append(self) or self)
    docs = make([(k, ("vile awful " if k % 3 == 0 else "kind gentle ") * 5 + str(k)) for k in range(60)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    assert not cached and model.curve[1] > 0


def test_pairs_sort_as_by_unique_and_lexsort():
    from tierwise.llm import pitman_yor

    draw = np.random.default_rng(3)
    for n in (0, 1, 5_000):
        w, c = draw.integers(0, 2**64, 40, dtype=np.uint64)[draw.integers(0, 40, n)], draw.integers(0, 2**48, 60, dtype=np.uint64)[draw.integers(0, 60, n)]
        order = pitman_yor.pair_order(w, c)
        want = np.lexsort((c, w))
        assert np.array_equal(np.sort(order), np.arange(n)) and np.array_equal(w[order], w[want]) and np.array_equal(c[order], c[want])
        kinds, first, which = pitman_yor.kinds_of(w)
        keys, inverse = np.unique(w, return_inverse=True)
        assert np.array_equal(kinds, keys) and np.array_equal(which, inverse) and np.array_equal(w[first], keys)
