"""Quality scores: histogram gradient-boosted trees over document statistics.

The statistics are counted in one pass over each text. The trees are grown on a bounded sample of labelled rows, over
histograms of binned statistics, and flattened into arrays; scoring walks all trees for a batch of documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import SAMPLE_ROWS, labelled_sample, map_batches

NAMES = (
    "chars", "words", "lines", "mean_word", "spread_word", "longest_word", "upper", "digit", "blank", "comma", "stop",
    "question", "sign", "other_sign", "non_ascii", "distinct_words", "top_word", "distinct_lines", "distinct_pairs",
    "words_with_sign", "words_with_digit", "upper_words", "line_words", "mark_ends", "distinct_letters", "letter_entropy",
)

KIND = np.full(256, 7, np.uint8)  # another ASCII sign
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b",;:", b".", b"!?", b"#$%&*|<>{}[]\\^~_=+@/")):
    KIND[list(_bytes)] = _kind
KIND[ord("a") : ord("z") + 1] = 8
KIND[128:] = 9


def statistics(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of a whole text; null is empty, for which all are zero."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, blank, comma, stop, mark, sign, other, lower, wide = np.bincount(KIND, weights=letters, minlength=10).tolist()
    size = float(len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    # Of distinct words, weighted by how often they come: as exact as looking at each word, and cheaper.
    signed = sum(c for w, c in counts.items() if not w.rstrip(b".,;:!?").isalnum() and w.isascii())
    numbered = sum(c for w, c in counts.items() if w[-1:].isdigit() or w[:1].isdigit())
    shouted = sum(c for w, c in counts.items() if w.isupper())
    ended = sum(c for w, c in counts.items() if w[-2:] in (b"!!", b"??", b".."))
    share = letters[letters > 0] / size
    return [
        size, float(len(words)), float(len(lines)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        upper / size, digit / size, blank / size, comma / size, stop / size, mark / size, sign / size, other / size, wide / size,
        len(counts) / n, max(counts.values(), default=0) / n, len(set(lines)) / len(lines), pairs / max(1, len(words) - 1),
        signed / n, numbered / n, shouted / n, n / len(lines), ended / n, float((letters > 0).sum()), float(-(share * np.log(share)).sum()),
    ]


@dataclass
class Trees:
    """All trees in one set of arrays. Leaves point to themselves, so every row takes ``depth`` equal steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``; all trees of all rows step down together."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0) -> Trees:
    """Boost the logistic loss. Statistics are cut at quantiles; a split has the best gain over the bins' sums.

    ``least`` is the smallest sum of second derivatives in a leaf's denominator (as a penalty) and the fewest rows of a leaf.
    Without rows, or with one label only, there is no tree and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(x.shape[1]) * bins
        margin = np.full(len(y), start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([])
            todo = [(roots[-1], np.arange(len(y)), depth)]
            while todo:
                at, rows, left = todo.pop()
                g, h = gradient[rows], hessian[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                value = rate * g.sum() / (h.sum() + 1)
                nodes[at] = [0, 0.0, at, at, value]
                if not left or len(rows) < 2 * least:
                    margin[rows] += value
                    continue
                where = flat[rows].ravel()
                total = x.shape[1] * bins
                sums = [np.bincount(where, np.repeat(w, x.shape[1]), total).reshape(-1, bins).cumsum(axis=1) for w in (g, h, np.ones(len(rows)))]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    margin[rows] += value
                    continue
                goes = binned[rows, f] <= b
                nodes[at] = [f, edges[f][b], len(nodes), len(nodes) + 1, 0.0]
                todo += [(len(nodes), rows[goes], left - 1), (len(nodes) + 1, rows[~goes], left - 1)]
                nodes += [[], []]
    columns = list(zip(*nodes, strict=True)) or [()] * 5
    feature, threshold, left, right, value = (np.array(c, t) for c, t in zip(columns, (np.int32, float, np.int32, np.int32, float), strict=True))
    return Trees(feature, threshold, left, right, value, np.array(roots, np.int32), depth, start)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Grow trees on at most about ``most_rows`` labelled training rows: only their statistics come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "label"])

    sample = labelled_sample(docs, labels, "quality", most_rows)
    # In one order whatever the partitions: sums of floats hang on it.
    rows = sorted((r["x"], r["label"]) for r in map_batches(sample, run, "x array<double>, label int").collect())
    x = np.array([r[0] for r in rows]).reshape(-1, len(NAMES))
    return grow(x, np.array([r[1] for r in rows], float), **options)


def scores(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, repeated ones and null ids included. Only the text is scored; null is empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):  # bounds rows x trees
                batch = whole.slice(start, 2000)
                x = np.array([statistics(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], names=["doc_id", "score"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, score double")
