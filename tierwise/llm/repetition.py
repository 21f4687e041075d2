"""Quality rules (3): repetition by suffix arrays.

The suffix array of a text's words shows every repeated substring: suffixes
that begin alike stand together, and the longest common prefix (LCP) of
neighbours says how far. Maximal repeats are the LCP intervals whose
occurrences are preceded by different words. The rules limit the fraction of
words that the union of all repeats of ``MIN_REPEAT`` words or more covers,
and the longest repeat, whose limit grows with the root of the text's words.

All texts of a slice share one suffix array: the first key of a suffix holds
its text, so that suffixes of different texts never tie. It is built by prefix
doubling over the suffixes that still tie, which soon are few; the ranks of
each doubling are kept, and LCPs follow from them by halving steps. Every text
is taken whole, whatever its length.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, _byte_set, over_texts, span_hashes, string_bytes, word_spans

#: Words of the shortest repeat that counts as covered.
MIN_REPEAT = 8
#: Limits of the rule: share of words covered by repeats, and words of the longest one by the
#: root of the text's words, so that a long text may not repeat a long passage. Each is the least
#: of its grid (steps of 0.05 and 0.25) that rejects at most 1 in 1,000 of the labelled texts of
#: quality 1 that the base rules keep (of check_s: 15 and 9 of 16,906).
MAX_COVERED, MAX_LONGEST_ROOT = 0.30, 1.5
#: Words of the longest repeat that every text may hold (an edit of a few lines often repeats a paragraph).
MIN_LONGEST = 50
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
IS_SYMBOL = _byte_set("#*$%&|<>")
IS_NEWLINE = _byte_set("\n")


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before) of ``words``; no common prefix crosses texts."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.int32 if n < 1 << 30 else np.int64
    order = np.lexsort((words, doc)).astype(kind)
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    place = np.arange(n, dtype=kind)
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    group_end = np.append(new[1:], True)
    tied = order[~(new & group_end)]
    k = 1
    ends = np.searchsorted(doc, doc, side="right").astype(kind)  # each suffix's end of text
    del new, group_end, order
    while len(tied):
        after = tied + k
        second = np.where(after < ends[tied], rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((second, rank[tied]))
        tied, first, second = tied[sort], rank[tied][sort], second[sort]
        at = np.arange(len(tied), dtype=kind)
        old = np.ones(len(tied), bool)
        old[1:] = first[1:] != first[:-1]
        new = old.copy()
        new[1:] |= second[1:] != second[:-1]
        rank[tied] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    suffixes = np.empty(n, kind)
    suffixes[rank] = place
    del place, ends
    return suffixes, _common_prefixes(words, doc, suffixes, rank)


def _common_prefixes(words: np.ndarray, doc: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array.

    In order of position (Kasai's order) the shared length falls by one word at
    most from a suffix to the next, so position plus length never falls. Where
    neither the suffix nor its neighbour before it can be told from the last
    position's pair by the word in front of both, the length is that pair's less
    one; only the other positions (the heads of such chains) compare words, all of
    them at once, by jumps that double and then halve over running hashes."""
    n = len(suffixes)
    before = np.empty(n, suffixes.dtype)  # the suffix before each one in the array
    before[suffixes[1:]], before[suffixes[0]] = suffixes[:-1], -1
    ok = before >= 0
    ok &= doc[np.maximum(before, 0)] == doc
    # position p continues the chain of p - 1 if its neighbour is the next one of that neighbour, and the words match
    chained = np.zeros(n, bool)
    chained[1:] = ok[1:] & ok[:-1] & (before[1:] == before[:-1] + 1) & (words[:-1] == words[before[:-1]]) & (doc[1:] == doc[:-1])
    heads = np.flatnonzero(ok & ~chained)
    length = np.zeros(n, np.int64)
    if len(heads):
        factor = np.uint64(0x9FB21C651E98DF25)
        powers = np.full(n + 1, factor)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], out=sums[1:])
        ends = np.searchsorted(doc, doc[heads], side="right")
        a, b = np.minimum(heads, before[heads]), np.maximum(heads, before[heads])
        room = ends - b
        got, step = np.zeros(len(heads), np.int64), 1 << max(0, int(room.max()).bit_length() - 1)
        while step:
            live = np.flatnonzero(got + step <= room)
            x, y = a[live] + got[live], b[live] + got[live]
            same = (sums[x + step] - sums[x]) * powers[y - x] == sums[y + step] - sums[y]
            got[live[same]] += step
            step >>= 1
        length[heads] = got
    # along a chain each length is the one before less one
    place = np.arange(n)
    head_of = np.maximum.accumulate(np.where(chained, 0, place))
    length[chained] = (length[head_of] - (place - head_of))[chained]
    return np.where(ok, length, 0)[suffixes]


def maximal_repeats(words: np.ndarray, suffixes: np.ndarray, lcp: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(first, last, words, document) for each LCP interval of at least ``least``
    words whose occurrences ``suffixes[first:last + 1]`` no common word precedes."""
    out = []
    stack: list[tuple[int, int]] = []  # (left end, words)
    high = np.flatnonzero(lcp >= least)
    before = np.where((suffixes > 0) & (doc[suffixes - 1] == doc[suffixes]), words[suffixes - 1], np.uint64(0)) if len(high) else words
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(high) else np.zeros(0, np.int64)

    def close(down_to: int, right: int) -> int | None:
        left = None
        while stack and stack[-1][1] > down_to:
            left, size = stack.pop()
            if changes[right] != changes[left]:
                out.append((left, right, size, int(doc[suffixes[left]])))
        return left

    last = -2
    for i, size in zip(high.tolist(), lcp[high].tolist()):
        if i != last + 1:
            close(0, last)
        left = close(size, i - 1)
        if not stack or stack[-1][1] < size:
            stack.append((left if left is not None else i - 1, size))
        last = i
    close(0, last)
    return out


def rules(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and the repetition figures of each text."""
    n = len(texts)
    buf, offsets = string_bytes(texts)
    start, end, doc = word_spans(buf, offsets)
    words = span_hashes(buf, start, end)
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)

    word_chars = per_text(~IS_SPACE[buf] & ((buf & 0xC0) != 0x80))
    line_start, line_end, line_doc = word_spans(buf, offsets, IS_NEWLINE)
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)  # lines with a word
    line, line_doc = span_hashes(buf, line_start[full], line_end[full]), line_doc[full]
    order = np.lexsort((line, line_doc))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    n_dup_lines = np.bincount(line_doc[order][again], minlength=n)

    suffixes, lcp = suffix_array(words, doc)
    longest_at = np.zeros(len(words), np.int64)  # each suffix's longest prefix that occurs elsewhere too
    longest_at[suffixes] = np.maximum(lcp, np.append(lcp[1:], 0))

    def covered(least: int, size: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(longest_at >= least)
        edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size[at], minlength=len(words) + 1)
        return np.bincount(doc[np.cumsum(edges)[: len(words)] > 0], minlength=n) if len(words) else np.zeros(n, np.int64)

    longest = np.zeros(n, np.int64)
    some = np.flatnonzero(n_words)
    if len(some):
        longest[some] = np.maximum.reduceat(longest_at, first[some])
    repeats = maximal_repeats(words, suffixes, lcp, doc, MIN_REPEAT)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_text(IS_SYMBOL[buf]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": covered(WINDOW, np.full(len(words), WINDOW)),
        "covered_words": covered(MIN_REPEAT, longest_at),
        "longest_repeat": np.where(longest >= MIN_REPEAT, longest, 0),
        "n_maximal_repeats": np.bincount(np.array([r[3] for r in repeats], np.int64), minlength=n),
    }


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_maximal_repeats"]


def repetition_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_covered: float = MAX_COVERED,
    max_longest_root: float = MAX_LONGEST_ROOT,
    min_longest: int = MIN_LONGEST,
) -> DataFrame:
    """(``id_col``, the counts, base_failed, repetitive, kept) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = rules(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(found[c].astype(np.int64)) for c in COLUMNS)], ["doc", *COLUMNS])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(over_texts(run), f"doc {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))
    words, longest = F.col("n_words"), F.col("longest_repeat")
    base_failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * words)
    repetitive = (F.col("covered_words") > max_covered * words) | ((longest > max_longest_root * F.sqrt(words)) & (longest >= min_longest))
    out = rows.withColumn("base_failed", base_failed).withColumn("repetitive", repetitive)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive")).withColumnRenamed("doc", id_col)
