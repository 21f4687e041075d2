"""Language ID (4): interpolated Kneser-Ney character models in sorted hash arrays.

Training. The n-grams (1 to ``ORDER`` characters, within a word and its two
borders) of labelled texts are counted per language by Spark. The highest
order uses the counts, lower orders the number of distinct characters seen
before an n-gram (continuation counts); each order is discounted by its own
d = n1 / (n1 + 2 n2) and interpolated with the next lower one, the lowest
with the uniform distribution over the characters seen. What a text needs is
then laid out in sorted hash arrays: for every n-gram, in any language, its
finished log-probability in each of them, and for every context its weight
for lower orders.

Prediction. Words are scored once per batch, however often they occur. A
text's language is the one with the lowest cross-entropy per character. Its
score is a soft maximum over the languages. A text is rejected when its
cross-entropy lies above a limit of that language and of its class of length
(powers of two of its characters). Sharpness and limits are fitted on training
texts held back from the n-grams, whole and cut into pieces of ``PIECES``
characters: of the pieces of each class, a share of REJECT_SHARE lies above its
limit, and a longer class has no higher limit than a shorter one.

The classifier is fitted on rows whose id hash is below a threshold per
language, ``MAX_TEXTS`` of them in expectation; n-grams of the bounded sample
are the whole model. Prediction covers every document whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and is rejected; empty texts are the same; with no labelled text every text is
``und``; ties go to the language that sorts first; repeated rows agree; an
empty table gives an empty result. A language of fewer than ``LEAST_HELD``
labelled texts holds none back and rejects no text with a letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_NO_LETTER, SpanHash, keep_texts, mix, over_texts, remainder, string_bytes, word_spans

ORDER = 5
#: Training texts of each language, in expectation.
MAX_TEXTS = 1_500
UNKNOWN = "und"
#: Share of training texts that is held back, in languages of at least LEAST_HELD texts.
HELD_BACK, LEAST_HELD = 5, 50
#: False rejections: the share of held-back pieces of a language and length above its limit.
REJECT_SHARE = 0.001
#: Pieces that show such a share; a class of fewer takes the next shorter one's limit, or, if there
#: is none, the most that any piece of the language has.
LEAST_PIECES = 5_000
PIECES = (16, 32, 64, 128, 256, 512, 1024)
CLASSES = 32
_BORDER = 0x20


@dataclass
class Grams:
    """One order's sorted hashes and a row of numbers for each."""

    keys: np.ndarray
    rows: np.ndarray
    index: np.ndarray  # first key for each value of the top bits

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Grams:
        top = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
        return cls(keys, rows, np.append(np.searchsorted(keys, top), len(keys)).astype(np.int64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent: a step down the sorted
        keys from where the top bits begin."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        top = (keys >> np.uint64(48)).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        rest = np.flatnonzero(at < end)
        while len(rest):
            held = self.keys[at[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[held < keys[rest]]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out


@dataclass
class Model:
    languages: list[str]
    floor: np.ndarray  # log-probability of a character never seen, by language
    grams: list[Grams]  # by order, from 1: log-probabilities
    contexts: list[Grams]  # by order of the n-gram they begin, from 1: log weights of the lower order
    sharpness: float = 1.0
    limit: np.ndarray | None = None  # by language and class of length


# ------------------------------------------------------------------ n-grams


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first, word, doc): each distinct word of letters in lower
    case with a border at both ends, and for every occurrence its word and text."""
    buf, offsets = string_bytes(pc.utf8_lower(texts.fill_null("")))
    start, end, doc = word_spans(buf, offsets, IS_NO_LETTER)
    _, place, word = np.unique(SpanHash(buf)(start, end), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    joined = b" ".join([raw[a:b] for a, b in zip(start[place].tolist(), end[place].tolist())])
    points = np.frombuffer((b" " + joined + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.flatnonzero(points == _BORDER)[: len(place)], word, doc


def gram_hashes(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram of ``order`` characters that ends at each position, hash of its context)."""
    n = len(points)
    gram = context = np.zeros(n, np.uint64)
    for back in range(order - 1, -1, -1):
        past = np.zeros(n, np.uint64)
        past[back:] = points[: max(n - back, 0)]
        context = gram
        gram = gram * np.uint64(0x9FB21C651E98DF25) + past + np.uint64(1)
    return mix(gram + np.uint64(order)), mix(context + np.uint64(order << 8))


def _count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, n-gram of the highest order that fits, n) as code points, by batch."""
    codes = batch.column("lang").to_numpy(zero_copy_only=False)
    out = []
    for lang in np.unique(codes):
        points, first, word, _ = words_of(batch.column("text").filter(pa.array(codes == lang)))
        if not len(first):
            continue
        times = np.bincount(word, minlength=len(first))
        owner = np.searchsorted(first, np.arange(1, len(points)), side="left") - 1  # a closing border is its word's
        n = times[owner]
        start = np.maximum(np.arange(1, len(points)) - ORDER + 1, first[owner])
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        grams: dict[str, int] = {}
        for a, b, c in zip(start.tolist(), range(2, len(points) + 1), n.tolist()):
            g = text[a:b]
            grams[g] = grams.get(g, 0) + c
        out.append((lang, grams))
    if not out:
        return None
    langs = np.concatenate([np.full(len(g), lang) for lang, g in out])
    return pa.RecordBatch.from_arrays(
        [pa.array(langs.astype(np.int32)), pa.array([x for _, g in out for x in g]), pa.array([x for _, g in out for x in g.values()], pa.int64())],
        ["lang", "gram", "n"],
    )


# ----------------------------------------------------------------- learning


def training_texts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, max_texts: int) -> DataFrame:
    """(lang, text, held) of labelled rows, each language thinned by id hash to ``max_texts`` in
    expectation; ``held`` marks one in HELD_BACK."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(4, id_col) != 2))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    held = (F.col("n") >= LEAST_HELD) & (F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(HELD_BACK)) == 0)
    thin = rows.join(F.broadcast(sizes), "lang").where(draw * F.col("n") < F.lit(max_texts << 30))
    return thin.select("lang", "text", F.coalesce(held, F.lit(False)).alias("held"))


def learn_languages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS
) -> Model:
    """The model. What reaches the driver is bounded by the sample: the n-grams of
    ``max_texts`` texts per language, and a few numbers for each text."""
    train = training_texts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, max_texts=max_texts)
    train = train.cache()
    try:
        languages = sorted(r.lang for r in train.where("NOT held").select("lang").distinct().collect())
        code = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1 if languages else F.lit(0)
        coded = train.select(code.alias("lang"), "text", "held").where("lang >= 0")
        counts = coded.where("NOT held").mapInArrow(over_texts(_count), "lang int, gram string, n long")
        if not languages:
            return Model([], np.zeros(0), [], [])
        table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        return _calibrate(kneser_ney(languages, table), coded.where("held"))
    finally:
        train.unpersist()


def kneser_ney(languages: list[str], table: pa.Table) -> Model:
    """Interpolated Kneser-Ney from counts of the longest n-gram that ends at each character."""
    grams, lang, n = table.column("gram").to_pylist(), table.column("lang").to_numpy(), table.column("n").to_numpy()
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    # counts of each order: tokens for n-grams that nothing can precede (the highest
    # order, and those that open a word), kinds of preceding characters for others
    orders: list[dict[tuple[int, str], int]] = [{} for _ in range(ORDER + 1)]
    for g, k, c, s in zip(grams, lang.tolist(), n.tolist(), size.tolist()):
        orders[s][k, g] = orders[s].get((k, g), 0) + c
    for s in range(ORDER, 1, -1):
        below = orders[s - 1]
        for k, g in orders[s]:
            below[k, g[1:]] = below.get((k, g[1:]), 0) + 1
    letters = {g for _, g in orders[1]}
    n_lang = len(languages)
    floor = np.full(n_lang, np.log(1 / (len(letters) + 1)))
    out = Model(languages, floor, [], [])
    lower: dict[str, np.ndarray] = {}
    for s in range(1, ORDER + 1):
        totals: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        zero = lambda: np.zeros(n_lang)
        for (k, g), c in orders[s].items():
            counts.setdefault(g, zero())[k] += c
            totals.setdefault(g[:-1], zero())[k] += c
            kinds.setdefault(g[:-1], zero())[k] += 1
        all_counts = np.array(list(counts.values())).reshape(-1, n_lang)
        n1, n2 = (all_counts == 1).sum(axis=0), (all_counts == 2).sum(axis=0)
        discount = np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1.0), 0.1, 0.95)
        names = list(counts)
        total = np.array([totals[g[:-1]] for g in names]).reshape(-1, n_lang)
        seen = total > 0
        weight = {h: np.where(t > 0, discount * kinds[h] / np.maximum(t, 1), 1.0) for h, t in totals.items()}
        base = np.exp(floor) if s == 1 else np.array([lower[g[1:]] for g in names]).reshape(-1, n_lang)
        share = np.where(seen, np.maximum(all_counts - discount, 0) / np.maximum(total, 1), 0.0)
        probability = share + np.array([weight[g[:-1]] for g in names]).reshape(-1, n_lang) * base
        lower = dict(zip(names, probability))
        out.grams.append(_arrays(names, np.log(probability), s, whole=True))
        out.contexts.append(_arrays(list(weight), np.log(np.array(list(weight.values())).reshape(-1, n_lang)), s, whole=False))
    return out


def _arrays(names: list[str], rows: np.ndarray, order: int, whole: bool) -> Grams:
    """Sorted by the hash that :func:`gram_hashes` gives the n-gram or its context."""
    width = order if whole else order - 1
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(names), width)
    h = np.zeros(len(names), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9FB21C651E98DF25) + points[:, k] + np.uint64(1)
    keys = mix(h + np.uint64(order if whole else order << 8))
    sort = np.argsort(keys)
    return Grams.of(keys[sort], rows[sort].astype(np.float32))


# --------------------------------------------------------------- prediction


def word_scores(model: Model, points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probability of each word (with its closing border) in every language."""
    n = len(points)
    score = np.zeros((n, len(model.languages)), np.float64)
    place = np.arange(n) - first[np.clip(np.searchsorted(first, np.arange(n), side="left") - 1, 0, None)]
    rest = np.arange(1, n)  # positions whose n-gram has not been found yet
    for s in range(ORDER, 0, -1):
        gram, context = gram_hashes(points, s)
        fits = rest[place[rest] >= s - 1] if s > 1 else rest
        row = model.grams[s - 1].find(gram[fits])
        hit = row >= 0
        score[fits[hit]] += model.grams[s - 1].rows[row[hit]]
        missed = fits[~hit]
        row = model.contexts[s - 1].find(context[missed])
        known = row >= 0
        score[missed[known]] += model.contexts[s - 1].rows[row[known]]
        rest = np.setdiff1d(rest, fits[hit], assume_unique=True)
    score[rest] += model.floor
    ends = np.append(first[1:], n - 1) if len(first) else first
    total = np.cumsum(score, axis=0)
    return total[ends] - total[first]


def _occurrences(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word) of every occurrence of a word; (characters, log-probability in each language) of the words."""
    points, first, word, doc = words_of(texts)
    if not len(first):
        return doc, word, np.zeros(0, np.int64), np.zeros((0, len(model.languages)))
    return doc, word, np.diff(np.append(first, len(points) - 1)), word_scores(model, points, first)


def _per_character(group, word, size, scores, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, cross-entropy per character in each language) of each group of occurrences."""
    n = np.bincount(group, weights=size[word], minlength=groups)
    bits = np.zeros((groups, scores.shape[1]))
    for k in range(scores.shape[1]):
        bits[:, k] = -np.bincount(group, weights=scores[word, k], minlength=groups)
    return n, bits / np.maximum(n, 1)[:, None]


def cross_entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(characters, cross-entropy per character in each language) of each text."""
    return _per_character(*_occurrences(model, texts), len(texts))


def length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n, 1)).astype(np.int64), 0, CLASSES - 1)


def has_letter(texts: pa.Array) -> np.ndarray:
    found = pc.match_substring_regex(texts.fill_null(""), r"\p{L}")
    return found.to_numpy(zero_copy_only=False)


def _pieces(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(characters, cross-entropies) of the texts and of their pieces of whole words."""
    doc, word, size, scores = _occurrences(model, texts)
    out = [_per_character(doc, word, size, scores, len(texts))]
    before = np.cumsum(size[word]) - size[word]
    place = before - before[np.searchsorted(doc, doc)]
    for length in PIECES if len(doc) else ():
        number = place // length
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        out.append(_per_character(np.cumsum(new) - 1, word, size, scores, int(new.sum())))
    return tuple(np.concatenate(x) for x in zip(*out))


def _calibrate(model: Model, held: DataFrame) -> Model:
    """Sharpness of the soft maximum, and the limits; a few numbers a held-back text reach the driver."""

    def gaps(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, bits = cross_entropies(model, batch.column("text"))
        at = np.arange(len(n)), batch.column("lang").to_numpy()
        own = bits[at]
        rest = bits.copy()
        rest[at] = np.inf
        gap = (rest.min(axis=1) - own) if bits.shape[1] > 1 else np.ones(len(n))
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(gap)], ["n", "gap"])

    def lows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, bits = _pieces(model, batch.column("text"))
        n, bits = n[n > 0], bits[n > 0]
        return pa.RecordBatch.from_arrays([pa.array(bits.argmin(axis=1)), pa.array(length_class(n)), pa.array(bits.min(axis=1))], ["lang", "class", "low"])

    rows = held.mapInArrow(over_texts(gaps), "n double, gap double").where("n > 0").toArrow()
    n, gap = (rows.column(c).to_numpy() for c in ("n", "gap"))
    if len(n):
        grid = np.geomspace(0.05, 50, 40)
        model.sharpness = float(grid[int(np.argmin([np.logaddexp(0, -t * np.sqrt(n) * gap).mean() for t in grid]))])
    seen = held.mapInArrow(over_texts(lows), "lang long, class long, low double").groupBy("lang", "class")
    seen = seen.agg(F.percentile("low", F.lit(1 - REJECT_SHARE)).alias("limit"), F.count(F.lit(1)).alias("n"), F.max("low").alias("top"))
    found = {(r["lang"], r["class"]): r for r in seen.collect()}  # CLASSES rows a language at most
    model.limit = np.full((len(model.languages), CLASSES), np.inf)
    for k in range(len(model.languages)):
        limit = max((r["top"] for (lang, _), r in found.items() if lang == k), default=np.inf)
        for c in range(CLASSES):
            if (k, c) in found and found[k, c]["n"] >= LEAST_PIECES:
                limit = found[k, c]["limit"]
            model.limit[k, c] = limit
    # no longer class above a shorter one
    model.limit = np.maximum.accumulate(model.limit[:, ::-1], axis=1)[:, ::-1]
    return model


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language or UNKNOWN, score, rejected, cross-entropy) of each text."""
    some = has_letter(texts)
    if not model.languages:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
    n, bits = cross_entropies(model, texts)
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(n)), best]
    soft = np.exp(-model.sharpness * np.sqrt(n)[:, None] * (bits - low[:, None]))
    names = np.where(some, np.array(model.languages, object)[best], UNKNOWN)
    return names, np.where(some, 1 / soft.sum(axis=1), 0.0), ~some | (low > model.limit[best, length_class(n)]), low


def identify_languages(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score, rejected, cross_entropy) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the classifier's sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, rejected, low = predict(held.value, batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(low)],
            ["doc", "lang_pred", "score", "rejected", "cross_entropy"],
        )

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"doc {kind}, lang_pred string, score double, rejected boolean, cross_entropy double"
    return rows.mapInArrow(over_texts(run), schema).withColumnRenamed("doc", id_col)


def drop_unidentified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that a learned language accounts for."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_texts(docs, lambda texts: ~predict(held.value, texts)[2], text_col)
