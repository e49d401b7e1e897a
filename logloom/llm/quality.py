"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics give conjunctive rules, a lasso logistic fit keeps few of them, and the kept
rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, release, views
from .tokens import PLAIN, Words, windows

#: Labelled rows that a fit reads at most, drawn by a hash of their id.
MAX_ROWS = 16384

_LINES = Words(b"\n", False)
_CLASS = np.zeros((8, 256))
for _row, _bytes in enumerate(
    (
        range(65, 91),  # upper case
        range(97, 123),  # lower case
        range(48, 58),  # digits
        b" \t\r\n\x0b\x0c",
        b".,;:?'\"-()",  # prose punctuation
        b"!#$%&*+/<=>@[\\]^_`{|}~",  # other symbols
        range(128, 256),
        range(0, 32),
    )
):
    _CLASS[_row, list(_bytes)] = 1

STATISTICS = (
    "log_bytes",
    "log_words",
    "upper",
    "lower",
    "digit",
    "blank",
    "prose_marks",
    "symbols",
    "beyond_ascii",
    "control",
    "word_bytes",
    "long_words",
    "distinct_words",
    "distinct_triples",
    "repeats_before",
    "top_word",
    "words_a_line",
    "repeated_lines",
    "sentence_marks",
)


def statistics(text: np.ndarray) -> list[float]:
    """The numbers of one whole text, in the order of ``STATISTICS``; all 0 without bytes."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(text, minlength=256)
    share = (_CLASS @ seen) / n
    h, start, end = PLAIN.hashes_and_bounds(text)
    words = len(h)
    if not words:
        return [float(np.log1p(n)), 0.0, *share, *[0.0] * 8, 0.0][: len(STATISTICS)]
    ordered = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    top = int(np.diff(np.append(first, words)).max())
    triples = windows(h, 3)
    lines = _LINES.hashes(text)
    size = end - start
    return [
        float(np.log1p(n)),
        float(np.log1p(words)),
        *share.tolist(),
        float(size.mean()),
        float((size > 15).mean()),
        len(first) / words,
        len(np.unique(triples)) / len(triples) if len(triples) else 1.0,
        float((h[1:] == h[:-1]).sum()) / words,
        top / words,
        float(np.log1p(words / max(1, len(lines)))),
        1 - len(np.unique(lines)) / max(1, len(lines)),
        int(seen[46] + seen[63] + seen[33]) / words,
    ]


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Adds one double for each statistic. A null text counts as empty."""
    made = T.StructType([T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS])
    empty = np.empty(0, np.uint8)

    def rows(batches):
        for batch in batches:
            got = np.array([statistics(empty if v is None else v) for v in views(batch.column(0))]).reshape(-1, len(STATISTICS))
            yield [pa.array(np.ascontiguousarray(got[:, j])) for j in range(len(STATISTICS))]

    return add_columns(df, text, made, rows)


@dataclass
class RuleModel:
    """Weighted conjunctions; a rule is a list of (statistic, below, threshold): statistic <= threshold or > threshold."""

    bias: float
    rules: list[tuple[list[tuple[int, bool, float]], float]] = field(default_factory=list)

    def column(self, prefix: str = "_q_") -> Column:
        """The score as a Spark expression over the statistics.

        The rules are one constant that the expression runs through. Written out as an IF for each rule, a few hundred of
        them pass the size at which Spark gives up compiling a stage, and take the driver hundreds of MB to find out.
        """
        written = json.dumps([{"w": w, "t": [{"j": j, "below": bool(below), "x": t} for j, below, t in tests]} for tests, w in self.rules])
        rules = F.from_json(F.lit(written), "array<struct<w: double, t: array<struct<j: int, below: boolean, x: double>>>>")
        numbers = F.array(*[F.col(f"`{prefix}{s}`") for s in STATISTICS])

        def total(x: Column) -> Column:
            met = lambda r: F.forall(r["t"], lambda t: (F.get(x, t["j"]) <= t["x"]) == t["below"])
            return F.aggregate(rules, F.lit(float(self.bias)), lambda acc, r: acc + F.when(met(r), r["w"]).otherwise(F.lit(0.0)))

        return 1.0 / (1.0 + F.exp(-F.get(F.transform(F.array(numbers), total), F.lit(0))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for tests, weight in self.rules:
            total += weight * _met(x, tests)
        return 1 / (1 + np.exp(-total))


def _met(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, t in tests:
        out &= (x[:, j] <= t) if below else (x[:, j] > t)
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, features: np.ndarray) -> tuple[list, np.ndarray]:
    """Paths of one tree fitted to gradients, and its output for each row."""
    out, paths = np.zeros(len(grad)), []

    def grow(rows: np.ndarray, tests: list, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        if tests:
            paths.append(tests)
        best = (1e-6, -1, 0)
        if left and len(rows) >= 20:
            for j in features:
                size = len(edges[j]) + 1
                gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], size))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], size))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 8) | (len(rows) - ns < 8)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), int(j), int(gain.argmax()))
        if best[1] < 0:
            out[rows] = g / (h + 1)
            return
        _, j, cut = best
        low = binned[rows, j] <= cut
        grow(rows[low], [*tests, (j, True, float(edges[j][cut]))], left - 1)
        grow(rows[~low], [*tests, (j, False, float(edges[j][cut]))], left - 1)

    grow(np.arange(len(grad)), [], depth)
    return paths, out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty by accelerated proximal gradients; the bias is free."""
    n, m = z.shape
    probe = np.random.Generator(np.random.PCG64(5)).normal(size=m).astype(np.float32)
    for _ in range(20):
        probe = z.T @ (z @ probe)
        probe /= np.linalg.norm(probe) + 1e-12
    step = 4 * n / (float(np.linalg.norm(z @ probe)) ** 2 + n)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, b = np.zeros(m, np.float32), float(np.log(p / (1 - p)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - step * (z.T @ r.astype(np.float32)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * float(r.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = (nw + (t - 1) / nt * (nw - w)).astype(np.float32), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw.astype(np.float32), nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weights from the lasso; its penalty is the best of a few on every fifth row left out.

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    if not len(y):
        return RuleModel(0.0)
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))))
    draw = np.random.Generator(np.random.PCG64(seed))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        bag = np.sort(draw.permutation(len(y))[: max(40, len(y) // 2)])
        features = np.sort(draw.permutation(x.shape[1])[: max(3, x.shape[1] // 2)])
        paths, out = _tree(binned[bag], edges, (y - p)[bag], (p * (1 - p))[bag], depth, features)
        for tests in paths:
            rules[tuple(tests)] = None
        for tests in paths:  # output of a leaf, for all rows
            at = _met(x[bag], tests)
            if at.any() and np.ptp(out[at]) == 0:
                f[_met(x, tests)] += 0.3 * out[at][0]
    kept: dict[bytes, tuple] = {}
    for tests in rules:
        met = _met(x, list(tests))
        if 0.002 < met.mean() < 0.998:
            kept.setdefault(np.packbits(met).tobytes(), tests)
    tests = list(kept.values())
    z = np.zeros((len(y), max(1, len(tests))), np.float32)
    for i, t in enumerate(tests):
        z[:, i] = _met(x, list(t))
    centre = z.mean(0, dtype=np.float64)
    scale = np.sqrt(centre * (1 - centre)) + 1e-6
    z -= centre.astype(np.float32)
    z /= scale.astype(np.float32)
    aside = np.arange(len(y)) % 5 == 0
    tried = []
    fitted, left = z[~aside], z[aside]
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        w, b = _lasso(fitted, y[~aside], penalty, 150)
        p = np.clip(1 / (1 + np.exp(-(left @ w + b))), 1e-6, 1 - 1e-6)
        loss = -float((y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean())
        tried.append((loss, penalty))
    del fitted, left
    w, b = _lasso(z, y, min(tried)[1])
    w = w / scale
    return RuleModel(float(b - (w * centre).sum()), [(list(t), float(x)) for t, x in zip(tests, w, strict=False) if abs(x) > 1e-4])


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; true for a null id, which is never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of their id.

    The label rows are broadcast (``max_rows`` at most). The fit runs in one task on as many rows of statistics; only the
    rules reach the driver. Null labels, ids and unlabelled rows are left out; a repeated row counts as often as it occurs.
    """
    chosen = labels.where(~held_out(key) & F.col(label).isNotNull()).select(F.col(f"`{key}`").alias("_id"), F.col(label).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    texts = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_key", "_y", "_text")
    rows = with_statistics(joined, "_text").drop("_text").orderBy(F.xxhash64("_key"), "_key", "_y").limit(max_rows)
    names = ["_q_" + s for s in STATISTICS]

    def run(batches):
        got = [np.column_stack([b.column(i).to_numpy() for i in range(len(names) + 1)]) for b in batches if b.num_rows]
        data = np.concatenate(got) if got else np.empty((0, len(names) + 1))
        model = fit_rules(data[:, 1:], data[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([model.bias, model.rules])])], names=["model"])
        release()

    found = rows.select("_y", *names).mapInArrow(run, "model string").first()
    if found is None:
        return RuleModel(0.0)
    bias, rules = json.loads(found.model)
    return RuleModel(bias, [([(j, below, t) for j, below, t in tests], w) for tests, w in rules])


def score_quality(df: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int); null and empty texts are scored too.

    Each row is scored by its text alone: repeated rows and equal texts get equal scores, and there are no ties to break.
    An empty table gives an empty one. Made columns replace input columns of their names.
    """
    scored = with_statistics(df, text).withColumn("score", model.column())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*["_q_" + s for s in STATISTICS])
