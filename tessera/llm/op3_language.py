"""Language identification with a byte convolutional network.

A text is cut into windows of ``LENGTH`` bytes (the last one is padded with
zeros).  Filters of several widths slide over a window's bytes, each filter
keeps its largest response, and a softmax layer turns these into language
probabilities.  A text's score is the mean over its windows, each weighted by
its letters.  The network is trained with Adam in numpy; a one-hot byte input
makes a convolution a sum of table rows, which at scoring time are pre-added
for byte pairs.

Edge cases: null text, empty text and text without a letter give ``und`` with
score 0; so does everything if no labelled row exists.  Rows are scored
independently, so ties and repeated rows give equal results.  Labelled rows without
a key are learned from like others; repeated rows count once.  Extra columns
are ignored or carried along by :func:`identify`, except ones named like its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrowmap import add_columns
from tessera.llm.kernels import slices, text_bytes
from tessera.llm.store import ship

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: rows of each language, windows of a row's text.
ROWS_A_LANGUAGE, WINDOWS_A_TEXT = 500, 4
EPOCHS, BATCH, RATE = 8, 64, 0.02

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class ByteConvNet:
    """``tables[w]``: (width, 256, FILTERS) responses; ``weights``, ``bias``: the softmax layer."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    shift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of LENGTH + 3 bytes (zeros at the end), and the text of each."""
    size = np.diff(offsets)
    count = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][doc] + nth * LENGTH
    left = offsets[1:][doc] - begin
    padded = np.concatenate([data, np.zeros(LENGTH + 3, np.uint8)])
    span = np.arange(LENGTH + 3)
    rows = padded[begin[:, None] + span]
    rows[span >= np.minimum(left, LENGTH)[:, None]] = 0
    return rows, doc


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def some_windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Up to WINDOWS_A_TEXT windows of each text, evenly spread over those with letters, and the text of each."""
    rows, doc = windows(*text_bytes(column))
    keep = np.flatnonzero(_LETTER[rows[:, :LENGTH]].sum(axis=1) >= LENGTH // 8)
    begins = np.flatnonzero(np.diff(doc[keep], prepend=-1) != 0)
    sizes = np.diff(np.append(begins, len(keep)))
    taken = np.minimum(sizes, WINDOWS_A_TEXT)
    nth = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
    keep = keep[np.repeat(begins, taken) + nth * np.repeat(sizes, taken) // np.repeat(np.maximum(taken, 1), taken)]
    return rows[keep], doc[keep]


def train(texts: list[str], labels: list[str], seed: int = 7) -> ByteConvNet | None:
    """Fit the network to texts and their languages; None without labelled text."""
    rows, doc = some_windows(pa.array(texts, pa.large_string()))
    return train_windows(rows, [labels[i] for i in doc], sorted(set(labels)), seed)


def train_windows(rows: np.ndarray, labels: list[str], languages: list[str], seed: int = 7) -> ByteConvNet | None:
    """Fit the network to windows and their languages; None without a language."""
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    code = {s: i for i, s in enumerate(languages)}
    x, y = rows.astype(np.int64), np.array([code[s] for s in labels], np.int64)
    n_features, k = FILTERS * len(WIDTHS), len(languages)
    params = {f"t{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    params |= {"shift": np.zeros(n_features, np.float32), "weights": rng.normal(0, 0.2, (n_features, k)).astype(np.float32), "bias": np.zeros(k, np.float32)}
    moment = {n: [np.zeros_like(p), np.zeros_like(p)] for n, p in params.items()}
    step = 0
    for _ in range(EPOCHS if k > 1 else 0):
        turn = rng.permutation(len(x))
        for at in range(0, len(turn), BATCH):
            xb, yb = x[turn[at : at + BATCH]], y[turn[at : at + BATCH]]
            n = len(xb)
            pooled, best = [], []
            for w in WIDTHS:
                response = sum(params[f"t{w}"][j][xb[:, j : j + LENGTH]] for j in range(w))
                b = response.argmax(axis=1)
                best.append(b)
                pooled.append(np.take_along_axis(response, b[:, None, :], 1)[:, 0])
            z = np.concatenate(pooled, axis=1) + params["shift"]
            h = np.maximum(z, 0)
            gap = _softmax(h @ params["weights"] + params["bias"])
            gap[np.arange(n), yb] -= 1
            gap /= n
            back = (gap @ params["weights"].T) * (z > 0)
            grads = {"weights": h.T @ gap, "bias": gap.sum(axis=0), "shift": back.sum(axis=0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[f"t{w}"])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(w):
                    np.add.at(g[j], (xb[np.arange(n)[:, None], best[i] + j], f), part)
                grads[f"t{w}"] = g
            step += 1
            for name, g in grads.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ByteConvNet(languages, {w: params[f"t{w}"] for w in WIDTHS}, params["shift"], params["weights"], params["bias"])


class Scorer:
    """Probabilities for whole texts, window by window in blocks that stay in cache."""

    BLOCK = 48

    def __init__(self, net: ByteConvNet) -> None:
        t, self.net = net.tables, net
        pair = np.concatenate([(t[w][0][:, None, :] + t[w][1][None, :, :]).reshape(65536, FILTERS) for w in WIDTHS], axis=1)
        self.pair = np.ascontiguousarray(pair + net.shift, np.float32)
        self.third = np.ascontiguousarray(t[3][2], np.float32)
        self.tail = np.ascontiguousarray((t[4][2][:, None, :] + t[4][3][None, :, :]).reshape(65536, FILTERS), np.float32)

    def features(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), FILTERS * 3), np.float32)
        for at in range(0, len(rows), self.BLOCK):
            b = rows[at : at + self.BLOCK].astype(np.int32)
            code = (b[:, :-1] << 8) | b[:, 1:]
            r = self.pair[code[:, :LENGTH]]
            r[:, :, FILTERS : 2 * FILTERS] += self.third[b[:, 2 : LENGTH + 2]]
            r[:, :, 2 * FILTERS :] += self.tail[code[:, 2 : LENGTH + 2]]
            out[at : at + self.BLOCK] = r.max(axis=1)
        return np.maximum(out, 0)

    def __call__(self, column: pa.Array) -> list:
        data, offsets = text_bytes(column)
        n, k = len(offsets) - 1, len(self.net.languages)
        rows, doc = windows(data, offsets)
        weight = _LETTER[rows[:, :LENGTH]].sum(axis=1).astype(np.float64)
        p = _softmax(self.features(rows) @ self.net.weights + self.net.bias) * weight[:, None]
        total, mass = np.zeros((n, k)), np.bincount(doc, weight, n)
        for j in range(k):
            total[:, j] = np.bincount(doc, p[:, j], n)
        total /= np.maximum(mass, 1e-9)[:, None]
        best = total.argmax(axis=1)
        known = mass > 0
        ascii_only = np.bincount(doc, (_LETTER[:128][np.minimum(rows[:, :LENGTH], 127)] & (rows[:, :LENGTH] < 128)).sum(axis=1), n)
        for i in np.flatnonzero(known & (ascii_only == 0)):
            known[i] = any(c.isalpha() for c in column[int(i)].as_py())
        lang = [self.net.languages[b] if ok else "und" for b, ok in zip(best, known)]
        return [lang, np.where(known, np.clip(total[np.arange(n), best], 0, 1), 0.0)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteConvNet | None:
    """The network of a bounded sample of labelled rows: at most ROWS_A_LANGUAGE of every language, WINDOWS_A_TEXT windows each.

    Rows are picked by a hash of key and text, at one rate a language, and only their windows reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), text).alias("h"))
    # One row a language: a class of the softmax layer, of which the driver has the weights.
    counts = labelled.groupBy("l").count().collect()
    if not counts:
        return None
    rates = spark.createDataFrame([(r[0], min(1.0, 4 * ROWS_A_LANGUAGE / r[1])) for r in counts], "l string, rate double")
    place = F.pmod(F.col("h"), F.lit(1 << 40))
    drawn = labelled.withColumn("place", place).join(F.broadcast(rates), "l").where(F.col("place") < F.col("rate") * float(1 << 40))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                rows, doc = some_windows(part.column("t"))
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                joined = [rows[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column("l"), part.column("place"), pa.array(joined, pa.binary())], ["l", "place", "w"])

    # The row of lowest hash in each of ROWS_A_LANGUAGE slots of a language; repeated rows share their slot.
    slot = F.pmod(F.col("place"), F.lit(ROWS_A_LANGUAGE))
    made = drawn.select("l", "place", "t").mapInArrow(cut, "l string, place long, w binary")
    got = made.groupBy("l", slot.alias("slot")).agg(F.min(F.struct("place", "w")).alias("best")).select("l", "slot", "best.w").toArrow()
    found = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist()))
    rows = np.frombuffer(b"".join(w for _, _, w in found), np.uint8).reshape(-1, LENGTH + 3)
    labels = [x for x, _, w in found for _ in range(len(w) // (LENGTH + 3))]
    return train_windows(rows, labels, sorted(r[0] for r in counts))


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text", keep: list[str] | None = None, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with ``pred`` and ``score``, for every row over its whole text."""
    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    if net is None:
        kept = docs.select(*keep) if keep else docs
        return kept.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    return add_columns(docs, text, fields, lambda: Scorer(net), keep, most=1 << 20)
