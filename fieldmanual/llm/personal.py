"""Personal data by candidate gradient boosting.

Patterns find base spans, which always stay.  High-recall generators propose further, overlapping spans; boosted
trees over format and context features score them, a calibrated threshold selects, and the best of overlapping
spans stays.  The trees learn from a bounded sample: base spans, seen without the marks that make them base spans,
against proposals that cannot be personal data.  Proposals that could be are what the trees decide, so they teach nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmanual.llm.common import part_of

# Fixed: kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # whole runs of digits: the same matches as without the bounds, in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

# Generators of proposals: numbers in groups, and addresses that avoid the sign.
NUMBERS = re.compile(r"[+(]?[0-9][0-9\x20().\-/]{5,}[0-9]")
_DOT, _LABEL = r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?", "[A-Za-z0-9-]+"
HIDDEN_AT = re.compile(rf"\x20?(?:\(at\)|\[at\])\x20?{_LABEL}(?:(?:{_DOT}|\.){_LABEL})+|(?:\x20?\x20at\x20\x20?|@){_LABEL}(?:\.{_LABEL})*(?:{_DOT}{_LABEL})+", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
WORDS = {"phone": ("phone", "tel", "call", "mobile", "fax", "cell"), "card": ("card", "visa", "master", "credit", "pay"), "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server")}
PART, DIGIT = re.compile(r"[^\x20]+"), re.compile("[0-9]")
MOST_DIGITS, MOST_PARTS, MOST_GAP = 19, 8, 3  # of a proposal: digits of a card, the longest kind; parts with digits; parts without any between them


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 if n < 5 else n * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, sorted; leftmost and non-overlapping within a kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and not NOT_LOCAL.match(text, begin - 1):
            begin -= 1
        end = EMAIL_END.match(text, at + 1) if begin < at else None
        if end:
            out.append((0, begin, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if _octets(m.group()):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return sorted(out)


def _number_rows(text: str, low: int, high: int) -> Iterator[tuple[int, int, int, bool]]:
    """(start, end, digits, single) of rows of neighbouring parts: at most ``MOST_DIGITS`` digits in at most ``MOST_PARTS``
    parts with digits, at most ``MOST_GAP`` parts without one between two of them.  Linear in the length of the text."""
    parts, gap, before = [], 0, None
    for w in PART.finditer(text, low, high):
        n = len(DIGIT.findall(w.group()))
        if n:
            parts.append((w.start(), w.end(), n, gap, before))
            gap, before = 0, None
        else:
            gap, before = gap + 1, w.start()
    for i, (begin, _, _, _, mark) in enumerate(parts):
        for start in (begin,) if mark is None else (mark, begin):
            total = 0
            for j in range(i, min(i + MOST_PARTS, len(parts))):
                _, end, n, gap, _ = parts[j]
                total += n
                if total > MOST_DIGITS or (j > i and gap > MOST_GAP):
                    break
                if text[end - 1].isdigit():
                    yield start, end, total, j == i and start == begin


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything that could be personal data, overlaps included."""
    out = []
    for m in NUMBERS.finditer(text):
        for begin, end, n, single in _number_rows(text, m.start(), m.end()):
            if single and IP.fullmatch(text, begin, end) and _octets(text[begin:end]):
                out.append((1, begin, end))
                continue
            if n >= 13 and text[begin] not in "+(":
                out.append((2, begin, end))
            if 9 <= n <= 15:
                out.append((3, begin, end))
    low = text.lower()
    low = ("(at)" in low or "[at]" in low or " at " in low or "@" in low) and ("(at)" in low or "[at]" in low or "(dot)" in low or "[dot]" in low or " dot " in low)
    if low:
        for m in HIDDEN_AT.finditer(text):
            begin = m.start()
            while begin > 0 and not NOT_LOCAL.match(text, begin - 1):
                begin -= 1
            if begin < m.start():
                out.append((0, begin, m.end()))
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > 0 and not NOT_LOCAL.match(text, begin - 1):
            begin -= 1
        end = EMAIL_END.match(text, at + 1)
        if end and begin < at:
            out.append((0, begin, end.end()))
        at = text.find("@", at + 1)
    return out


def plausible(kind: int, s: str) -> bool:
    """Formats that a selected proposal must have, whatever its score: a rule that a kind must obey is not learnt away."""
    digits, groups = _digits(s), [len(g) for g in re.findall(r"[0-9]+", s)]
    if kind == 0:
        return ADDRESS.fullmatch(plain(kind, s)) is not None
    if kind == 1:
        return _octets(s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15 and 3 <= len(groups) <= 5 and max(groups) <= 4 and groups[-1] >= 3 and groups[0] <= 3
    return True


def plain(kind: int, s: str) -> str:
    """The span without what tells a base span from a hidden one: spelt signs, the plus, the kind of separator."""
    if kind == 0:
        return re.sub(r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?", ".", re.sub(r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?", "@", s, flags=re.I), flags=re.I)
    return re.sub(r"[\x20./()-]+", " ", s.lstrip("+(")) if kind in (2, 3) else s


def _around(text: str, begin: int, end: int) -> tuple[str, str, float]:
    """Text before and after a span, and the share of digits in both."""
    before, after = text[max(0, begin - 24):begin].lower(), text[end:end + 12]
    return before, after, sum(c.isdigit() for c in before + after) / (len(before + after) or 1)


def features(text: str, kind: int, begin: int, end: int) -> list[float]:
    """Format of the span in its plain form, and its surroundings."""
    s, (before, after, numeric) = plain(kind, text[begin:end]), _around(text, begin, end)
    digits = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    return [kind, len(digits), len(groups) if kind else 0, max(groups) if kind else 0, groups[-1] if kind else 0, groups[0] if kind == 2 else 0,
            float(luhn(digits)) if kind == 2 and 13 <= len(digits) <= 19 else -1.0, float(_octets(s)) if kind == 1 else -1.0, float(plausible(kind, text[begin:end])),
            float(any(w in before for w in WORDS[KINDS[kind]])), sum(c.isalpha() for c in before) / (len(before) or 1), numeric, float(before[-1:].isalnum()), float(after[:1].isalnum())]


def examples(text: str) -> list[tuple[bool, list[float]]]:
    """What a text teaches: its base spans, and proposals that break their format, stand in a word or among numbers."""
    base = base_spans(text)
    known = set(base)
    out = [(True, features(text, *c)) for c in base]
    for k, b, e in dict.fromkeys(proposals(text)):
        before, after, numeric = _around(text, b, e)
        if (k, b, e) not in known and (not plausible(k, text[b:e]) or before[-1:].isalnum() or after[:1].isalnum() or numeric > 0.5):
            out.append((False, features(text, k, b, e)))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
    """Gradient-boosted trees with logistic loss: a start value, and per tree the arrays feature, cut, value by node."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    margin, made, nodes = np.full(len(y), start), [], 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + 1)
            best = (1e-6, -1, 0.0)
            if node < nodes // 2:
                for f, edges in enumerate(cuts):
                    if len(edges):
                        bin_of = np.searchsorted(edges, x[rows, f], side="left")
                        gl = np.cumsum(np.bincount(bin_of, g[rows], len(edges) + 1))[:-1]
                        hl = np.cumsum(np.bincount(bin_of, h[rows], len(edges) + 1))[:-1]
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], f, edges[i])
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        margin += value[at]
        made.append((feature, cut, value))
    return start, made


def tree_margins(model, x: np.ndarray) -> np.ndarray:
    start, trees = model
    out = np.full(len(x), start)
    for feature, cut, value in trees:
        at = np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            at[inner] = 2 * at[inner] + 1 + (x[inner, f[inner]] > cut[at[inner]])
        out += value[at]
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float, float]:
    """Scale and shift of a logistic calibration, and the least probability from which the precision holds."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, r = np.maximum(p * (1 - p), 1e-9), target - p
        hessian = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, np.array([(r * margin).sum(), r.sum()]))
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    order = np.argsort(-margin, kind="stable")
    good = np.flatnonzero(np.cumsum(y[order]) >= precision * np.arange(1, len(y) + 1))
    least = margin[order[good[-1]]] if len(good) else np.inf
    return float(a), float(b), float(max(0.9, 1 / (1 + np.exp(-np.clip(a * least + b, -30, 30)))) if np.isfinite(least) else 2.0)


def fit_personal(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 20_000, most_candidates: int = 40_000, precision: float = 0.99):
    """Trees and calibration from about ``sample_rows`` documents and at most ``most_candidates`` of their examples.

    Examples from half of the documents grow the trees, those from the other half calibrate.  None if a half of the
    sample lacks one of the classes.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for order, t in zip(batch["order"], batch["text"]):
                if t:
                    out += [(order, i, good, x) for i, (good, x) in enumerate(examples(t))]
            yield pd.DataFrame(out, columns=["order", "at", "good", "x"])

    slim = part_of(documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", sample_rows)
    rows = slim.select(F.xxhash64("doc_id", "text").alias("order"), "text").mapInPandas(label, "order long, at int, good boolean, x array<double>")
    found = rows.orderBy("order", "at").limit(most_candidates).toPandas()
    if found.empty:
        return None
    x, y, half = np.stack(found["x"].tolist()), found["good"].to_numpy(float), found["order"].to_numpy() % 2 == 0
    if min(y[half].sum(), (1 - y[half]).sum(), y[~half].sum(), (1 - y[~half]).sum()) < 1:
        return None
    trees = fit_trees(x[half], y[half])
    return trees, calibrate(tree_margins(trees, x[~half]), y[~half], precision)


def selected_spans(text: str, base: list[tuple[int, int, int]], model) -> list[tuple[int, int, int]]:
    """Proposals beside base spans whose calibrated probability reaches the threshold, the best of overlapping ones."""
    if model is None:
        return []
    starts, ends = _merged(base)
    free = [c for c in dict.fromkeys(proposals(text)) if not _meets(starts, ends, c) and plausible(c[0], text[c[1]:c[2]])]
    if not free:
        return []
    trees, (a, b, least) = model
    p = 1 / (1 + np.exp(-np.clip(a * tree_margins(trees, np.array([features(text, *c) for c in free])) + b, -30, 30)))
    out: list[tuple[int, int, int]] = []
    starts, ends = [], []
    for i in np.lexsort((-np.array([c[2] - c[1] for c in free]), -np.round(p, 2))):
        if p[i] >= least and not _meets(starts, ends, free[i]):
            at = bisect_left(starts, free[i][1])
            starts.insert(at, free[i][1])
            ends.insert(at, free[i][2])
            out.append(free[i])
    return out


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for _, b, e in sorted(spans, key=lambda c: c[1]):
        if ends and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(b)
            ends.append(e)
    return starts, ends


def _meets(starts: list[int], ends: list[int], span: tuple[int, int, int]) -> bool:
    """Whether a span overlaps one of the disjoint, sorted ones."""
    at = bisect_left(starts, span[2]) - 1
    return at >= 0 and ends[at] > span[1]


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in sorted(spans))


def find_personal(documents: DataFrame, key: str = "doc_id", text: str = "text", model=None, **options) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans`` (all, as a line), ``n_added`` per row.

    A null text is empty and has no spans.  Repeated rows and null keys are rows of their own; an empty table gives no
    rows.  Texts of any length are read whole; positions are code points.  ``model`` as made by :func:`fit_personal`,
    fitted on these documents if not given.
    """
    model = model or fit_personal(documents, key, text, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    kind = dict(documents.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            out = []
            for t in batch["text"]:
                base = base_spans(t) if t else []
                added = selected_spans(t, base, fitted) if t else []
                counts = np.bincount([k for k, _, _ in base], minlength=4).tolist()
                out.append((*counts, hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + added), len(added)))
            made = pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], made], axis=1)

    return documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(
        find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
