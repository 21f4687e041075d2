"""Toxicity (1): maximum-scoring segments of token log-odds, with extreme-value calibration.

Model, learned from labelled documents:
* A token is a run of letters in lower case. Its log-odds between toxic and
  clean documents have an informative Dirichlet prior: a token's class rates
  are drawn to those of its stem (first ``STEM`` letters), a stem's to the
  corpus rates. So a rare or unseen word takes its stem's evidence.
* Every token gets its log-odds less a drift, which makes the expected score
  of clean text negative; most tokens are unknown and get the drift alone.
* Over clean text, the best segment of n tokens follows an extreme-value law
  P(S > x) = 1 - exp(-K n exp(-lambda x)). lambda solves E[exp(lambda s)] = 1
  for clean tokens, K is its maximum-likelihood value on clean documents.

Scoring: one linear scan finds all maximal scoring segments (each token that
the model does not know is part of a run, which counts as one step). Segments
whose expected number by chance is below ``MAX_EXPECTED`` are significant;
their surprise, -log of that number, adds up to a document's evidence, and a
logistic curve over its logarithm, fitted on training documents, makes it a
probability.

The classifier is fitted on labelled rows whose id hash is below a threshold,
``MAX_LABELLED`` of them in expectation (all, when there are fewer). Scoring
covers every document whole.

Defined cases: null and empty texts and texts without letters have no
segments and get the probability of no evidence; repeated rows score alike;
without toxic or clean labels the score is the share of toxic labels (0 where
there are none); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_NO_LETTER, SpanHash, keep_texts, over_texts, remainder, stored, string_bytes, word_spans

#: Labelled rows that the classifier is fitted on, in expectation.
MAX_LABELLED = 20_000
STEM = 5
STEM_PRIOR, TOKEN_PRIOR = 2.0, 4.0  # pseudo-documents behind a stem's and a token's prior
MIN_Z = 4.0  # words whose signed root of the likelihood ratio is smaller are left at the drift
DRIFT = 0.5
MAX_EXPECTED = 0.05
#: Bytes of text that a task turns into arrays at a time: some 50 bytes of arrays for each.
PIECE_BYTES = 1 << 18


@dataclass
class Model:
    """Scores by sorted token hash and by sorted stem hash; the rest are numbers."""

    tokens: np.ndarray
    token_scores: np.ndarray
    stems: np.ndarray
    stem_scores: np.ndarray
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = field(default=(0.0, 0.0))  # log-odds = curve[0] + curve[1] * log(1 + evidence)


# ------------------------------------------------------------------- tokens


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, stem hash, document) of every run of letters, in lower case."""
    buf, offsets = string_bytes(pc.utf8_lower(texts.fill_null("")))
    start, end, doc = word_spans(buf, offsets, IS_NO_LETTER)
    hashes = SpanHash(buf)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of code points
    nth = np.searchsorted(lead, start) + STEM
    stem_end = np.minimum(np.append(lead, len(buf))[np.minimum(nth, len(lead))], end)
    return hashes(start, end), hashes(start, stem_end) ^ np.uint64(0x5151515151515151), doc


def _count_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(token, stem, toxic, n): documents of each label that have a token, by batch."""
    token, stem, doc = tokens_of(batch.column("text"))
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
    order = np.lexsort((token, doc))
    token, stem, doc, toxic = token[order], stem[order], doc[order], toxic[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, stem, toxic = token[new], stem[new], toxic[new]
    order = np.argsort(token, kind="stable")
    token, stem, toxic = token[order], stem[order], toxic[order]
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    n_toxic = np.add.reduceat(toxic, at) if len(at) else toxic
    n_all = np.diff(np.append(at, len(token)))
    return pa.RecordBatch.from_arrays(
        [pa.array(token[at].view(np.int64)), pa.array(stem[at].view(np.int64)), pa.array(n_toxic), pa.array(n_all - n_toxic)],
        ["token", "stem", "toxic", "clean"],
    )


# ---------------------------------------------------------------- the scan


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), each of positive score,
    in linear time. A candidate keeps the running totals before and after it
    and where the nearest earlier one with a lower total before it stands; it
    swallows that one and all between when its total after is higher."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest lower
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]  # all between have higher totals before them
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, low, total, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _scores(model: Model, token: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the tokens that the model knows."""
    def look(keys, values, of):
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == of)
        return hit, values[at[hit]]

    at, score = look(model.stems, model.stem_scores, stem)
    out = np.zeros(len(token))
    out[at] = score
    at2, score2 = look(model.tokens, model.token_scores, token)
    out[at2] = score2
    known = np.union1d(at, at2)
    known = known[out[known] != 0]
    return known, out[known]


def segments_of(model: Model, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """(tokens, maximal segments in tokens) of each text."""
    token, stem, doc = tokens_of(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    at, score = _scores(model, token, stem)
    bounds = np.searchsorted(at, np.append(first, len(token)))
    out: list[tuple[int, list]] = []
    for k, size in enumerate(n.tolist()):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            out.append((size, []))
            continue
        # a known token, then the drift of the unknown ones up to the next: two steps each
        where = (at[a:b] - first[k]).tolist()
        steps = []
        for i, (p, s) in enumerate(zip(where, score[a:b].tolist())):
            gap = (where[i + 1] if i + 1 < len(where) else size) - p - 1
            steps += [s - model.drift, -model.drift * gap]
        out.append((size, [(where[i // 2], where[(j - 1) // 2] + 1, s) for i, j, s in maximal_segments(steps)]))
    return out


def surprise(model: Model, size: int, segments: list) -> tuple[float, list]:
    """(evidence, significant segments): -log of the segments' expected number by chance, summed."""
    found = []
    for a, b, s in segments:
        log_expected = np.log(model.k * max(size, 1)) - model.lam * s
        if log_expected < np.log(MAX_EXPECTED):
            found.append((a, b, s, float(-log_expected)))
    return sum(f[3] for f in found), found


# ----------------------------------------------------------------- learning


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """(text, toxic): labelled training rows, thinned by id hash to ``max_labelled`` in expectation."""
    rows = labels.where("toxic IS NOT NULL").select(F.col(id_col).alias("id"), (F.col("toxic") > 0).cast("long").alias("toxic"))
    rows = rows.where(remainder(5, "id") != 0)
    n = rows.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))  # bounded: about max_labelled rows
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("text", "toxic")


def fit(train: DataFrame) -> Model:
    """The model, from (text, toxic) rows. What reaches the driver is bounded:
    tokens with clear log-odds, and two numbers per training row."""
    train = train.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")
    ).select("text", "toxic")  # a text counts once, however many copies carry a label
    return _fit(stored(train, "labelled"))  # a cache would fill the executors' heaps, which don't shrink again


def _fit(train: DataFrame) -> Model:
    none = np.zeros(0, np.uint64), np.zeros(0)
    totals = train.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals.toxic or 0, totals.n - (totals.toxic or 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Model(*none, *none, curve=(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0))

    counts = train.mapInArrow(over_texts(_count_tokens, limit=PIECE_BYTES), "token long, stem long, toxic long, clean long")
    counts = stored(counts.groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tokens")
    stems = counts.groupBy("stem").agg(F.sum("toxic").alias("s_toxic"), F.sum("clean").alias("s_clean"))
    share = toxic / (toxic + clean)

    def log_odds(t, c, prior_t, prior_c):
        """(log-odds over pseudo-documents, signed root of the likelihood ratio) of a
        word that ``t`` toxic and ``c`` clean documents have."""
        delta = F.log((t + prior_t) / (toxic - t + prior_t + 1)) - F.log((c + prior_c) / (clean - c + prior_c + 1))
        part = lambda k, rate: F.when(k > 0, k * F.log(k / ((t + c) * rate))).otherwise(0.0)
        ratio = 2 * (part(t, share) + part(c, 1 - share))
        return delta, F.signum(t / (t + c) - share) * F.sqrt(F.greatest(ratio, F.lit(0.0)))

    # a stem's prior has the corpus rates; a token's has its stem's
    stem_delta, stem_z = log_odds(F.least("s_toxic", F.lit(toxic)), F.least("s_clean", F.lit(clean)), STEM_PRIOR * share, STEM_PRIOR * (1 - share))
    stem_rows = stems.select("*", stem_delta.alias("stem_delta"), stem_z.alias("stem_z"))
    rate = (F.col("s_toxic") + STEM_PRIOR * share) / (F.col("s_toxic") + F.col("s_clean") + STEM_PRIOR)
    rows = counts.join(stem_rows, "stem")
    delta, z = log_odds(F.col("toxic"), F.col("clean"), TOKEN_PRIOR * rate, TOKEN_PRIOR * (1 - rate))
    rows = rows.select("token", "stem", "toxic", "clean", delta.alias("delta"), z.alias("z"), "stem_delta", "stem_z")

    by_stem = stem_rows.where(f"abs(stem_z) >= {MIN_Z} AND s_toxic + s_clean >= 3").select("stem", "stem_delta").toArrow()
    by_token = rows.where(f"abs(z) >= {MIN_Z} OR abs(stem_z) >= {MIN_Z}")
    by_token = by_token.where("toxic + clean >= 2").select("token", F.expr(f"CASE WHEN abs(z) >= {MIN_Z} THEN delta ELSE 0.0 END").alias("delta")).toArrow()

    def table(arrow, key, value):
        k = arrow.column(key).to_numpy().view(np.uint64)
        order = np.argsort(k)
        return k[order], arrow.column(value).to_numpy()[order]

    model = Model(*table(by_token, "token", "delta"), *table(by_stem, "stem", "stem_delta"))
    return _calibrate(model, train)


def _calibrate(model: Model, train: DataFrame) -> Model:
    def clean_scores(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, stem, doc = tokens_of(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc] > 0
        at, score = _scores(model, token, stem)
        score, n = np.round(score[~toxic[at]], 1), int((~toxic).sum())
        value, count = np.unique(score, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(value, 0.0)), pa.array(np.append(count, n - count.sum()).astype(np.int64))], ["score", "n"]
        )

    spread = train.mapInArrow(over_texts(clean_scores, limit=PIECE_BYTES), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    score, n = spread.column("score").to_numpy() - model.drift, spread.column("n").to_numpy().astype(float)
    n /= max(1.0, n.sum())
    low, high = 1e-4, 50.0
    for _ in range(100):  # E[exp(lambda s)] falls below 1, then rises through it once
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.exp(np.minimum(mid * score, 500))).sum() < 1 else (low, mid)
    model.lam = min(max(low, 0.05), 2.0)

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = segments_of(model, batch.column("text"))
        top = [max((s for *_, s in segments), default=0.0) for _, segments in found]
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array(top, pa.float64())], ["toxic", "n", "best"])

    seen = train.mapInArrow(over_texts(best, limit=PIECE_BYTES), "toxic long, n long, best double")
    row = seen.where("toxic = 0 AND n > 0").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("n") * F.exp(-F.lit(model.lam) * F.col("best"))).alias("e")
    ).first()
    model.k = min(1.0, max(row.c, 1) / max(row.e or 1.0, 1e-9))

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [surprise(model, n, segments)[0] for n, segments in segments_of(model, batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], ["toxic", "evidence"])

    rows = train.mapInArrow(over_texts(evidence, limit=PIECE_BYTES), "toxic long, evidence double").toArrow()  # max_labelled rows
    model.curve = _logistic(np.log1p(rows.column("evidence").to_numpy()), rows.column("toxic").to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a small ridge."""
    scale = max(1.0, float(x.max(initial=0.0)) / 10)
    design = np.stack([np.ones(len(x)), x / scale], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((design * w[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -3, 3)
    return float(beta[0]), float(beta[1] / scale)


# ------------------------------------------------------------------- Spark


def probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """(score, evidence, (tokens, significant segments)) of each text."""
    found = [(n, surprise(model, n, segments)) for n, segments in segments_of(model, texts)]
    evidence = np.array([f[1][0] for f in found], float)
    score = 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * np.log1p(evidence), -60, 60)))
    return score, evidence, [(n, segments) for n, (_, segments) in found]


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score, evidence, n_tokens, segments): segments are the
    significant ones as (first token, end, score, surprise)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the classifier's sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, evidence, found = probabilities(held.value, batch.column("text"))
        segments = [[{"first": a, "end": b, "score": float(s), "surprise": e} for a, b, s, e in f] for _, f in found]
        item = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("surprise", pa.float64())])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(score), pa.array(evidence), pa.array([f[0] for f in found], pa.int64()), pa.array(segments, pa.list_(item))],
            ["doc", "score", "evidence", "n_tokens", "segments"],
        )

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"doc {kind}, score double, evidence double, n_tokens long, segments array<struct<first:long,end:long,score:double,surprise:double>>"
    return rows.mapInArrow(over_texts(run, limit=PIECE_BYTES), schema).withColumnRenamed("doc", id_col)


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_texts(docs, lambda texts: probabilities(held.value, texts)[0] < threshold, text_col, PIECE_BYTES)


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    return fit(labelled(docs, labels, id_col, text_col, max_labelled))
