"""A brute-force, per-entity model of the method's documented steps.

Written independently of the library: plain Python over lists of records,
following the step order of each method (filters applied one after another,
exact distinct counts). Used to check the Spark operators on random data.
"""

from collections import Counter, defaultdict

UNRESOLVED = "unresolved"
SOURCE_ORDER = ["apc", "ae", "op"]


def tier(code, not_valid, other):
    if code is not None and code in not_valid:
        return 0
    if other:
        if code is not None and code in other:
            return 1
        return 2
    return 1


def group(rows):
    g = defaultdict(list)
    for r in rows:
        g[r["entity"]].append(r)
    return g


def top_rows(rs, not_valid, other):
    m = max(tier(r["category"], not_valid, other) for r in rs)
    return [r for r in rs if tier(r["category"], not_valid, other) == m]


def modal(rs):
    codes = {r["category"] for r in rs if r["category"] is not None}
    counts = Counter(r["category"] for r in rs if r["category"] is not None)
    mx = max(counts.values()) if counts else 0
    cands = {c for c in codes if counts[c] == mx}
    if len(cands) > 1:
        return UNRESOLVED
    return next(iter(cands)) if cands else None


def _rank(s):
    return SOURCE_ORDER.index(s) + 1 if s in SOURCE_ORDER else None


def _keep_extreme(rs, keyf, fn, by_date=True):
    """Keep rows whose keyf equals fn (max/min) of keyf over rows with the same date."""
    groups = defaultdict(list)
    for r in rs:
        groups[r["observed_at"] if by_date else 0].append(r)
    out = []
    for g in groups.values():
        vals = [keyf(r) for r in g if keyf(r) is not None]
        if not vals:
            continue
        best = fn(vals)
        out += [r for r in g if keyf(r) == best]
    return out


def _at_max_date(rs):
    ds = [r["observed_at"] for r in rs if r["observed_at"] is not None]
    if not ds:
        return []
    m = max(ds)
    return [r for r in rs if r["observed_at"] == m]


def latest_realloc(rs, rule, not_valid, other):
    """List of (row, value) kept by the re-allocated method for one entity."""
    t = top_rows(rs, not_valid, other)
    nd = len({r["category"] for r in t if r["category"] is not None})
    if nd == 1:
        return [(r, r["category"]) for r in _at_max_date(t)]
    m = t
    if rule == "source":
        m = _keep_extreme(m, lambda r: _rank(r["source"]), min)
    m = _at_max_date(m)
    if rule == "flag":
        m = _keep_extreme(m, lambda r: r["flag"], max)
    n = len({r["category"] for r in m if r["category"] is not None})
    return [(r, UNRESOLVED if n > 1 else r["category"]) for r in m]


HISTORIC = object()  # an out-of-band marker: a real code never equals it


def latest_plain(rs, rule):
    ds = [r["observed_at"] for r in rs if r["observed_at"] is not None]
    maxd = max(ds) if ds else None
    marked = [(r, r["category"] if (maxd is not None and r["observed_at"] == maxd) else HISTORIC) for r in rs]
    if rule == "source":
        keep = {id(r) for r in _keep_extreme(rs, lambda r: _rank(r["source"]), min)}
        marked = [(r, v) for r, v in marked if id(r) in keep]
    marked = [(r, v) for r, v in marked if v is not HISTORIC and v is not None]
    if rule == "flag":
        keep = {id(r) for r in _keep_extreme([r for r, _ in marked], lambda r: r["flag"], max)}
        marked = [(r, v) for r, v in marked if id(r) in keep]
    n = len({v for _, v in marked})
    return [(r, UNRESOLVED if n > 1 else v) for r, v in marked]
