"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters of WIDTH bytes run over the whole document every STRIDE bytes; their responses are max-pooled
within overlapping chunks of two blocks. The document's pooled vector is the maximum and the mean over its chunks, and a
logistic layer makes one probability of it. The network is trained on a bounded sample, by Adam, with exact gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.boosting import sigmoid
from plazaflow.llm.common import batches, held_out, utf8
from plazaflow.llm.labelled import labelled_sample

#: Labelled rows that are learned from, at most, each by its whole text; rows of longer texts are not among them.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 10
WIDTH, STRIDE, DIM, FILTERS = 8, 4, 8, 24
#: A chunk is two neighbouring blocks, so chunks overlap by half. PAD is the embedding's row past a text's end.
BLOCK, PAD = 256, 256
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-5


@dataclass
class Network:
    embed: np.ndarray  # 257 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    start: np.ndarray  # one number

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.start]


def fresh(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
    return Network(f(257, DIM, by=0.5), f(WIDTH * DIM, FILTERS, by=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), f(2 * FILTERS, by=0.1), np.zeros(1, np.float32))


def blocks_of(size: np.ndarray) -> np.ndarray:
    """Blocks of texts of so many bytes; an empty text has one, and every text ends in WIDTH pads at least."""
    return (size + WIDTH + BLOCK - 1) // BLOCK


def laid_out(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in whole blocks, padded, and the first block of each (one more entry than texts)."""
    size = np.diff(starts)
    first = np.r_[0, np.cumsum(blocks_of(size))]
    buffer = np.full(first[-1] * BLOCK + WIDTH, PAD, np.int16)
    buffer[np.arange(len(raw)) + np.repeat(first[:-1] * BLOCK - starts[:-1], size)] = raw
    return buffer, first


def pooled_blocks(net: Network, buffer: np.ndarray, first: np.ndarray, most: int = 2048) -> np.ndarray:
    """Largest response of each filter in each block, 0 at least. Windows start every STRIDE bytes: as many passes over
    windows that don't overlap as strides in a width, each one matrix product without a copy. A window that leaves a text's
    last block, which ends in pads, doesn't count: it would see the next text."""
    number = (len(buffer) - WIDTH) // BLOCK
    ends = np.zeros(number, bool)
    ends[first[1:] - 1] = True
    out = np.empty((number, FILTERS), np.float32)
    for a in range(0, number, most):
        b = min(number, a + most)
        inputs = net.embed[buffer[a * BLOCK : b * BLOCK + WIDTH]]
        best = None
        for shift in range(0, WIDTH, STRIDE):
            z = (inputs[shift : shift + (b - a) * BLOCK].reshape(-1, WIDTH * DIM) @ net.filters).reshape(b - a, -1, FILTERS)
            if shift:
                z[ends[a:b], -1] = -np.inf
            best = z.max(1) if best is None else np.maximum(best, z.max(1))
        out[a:b] = np.maximum(best + net.bias, 0)
    return out


def combined(blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum and mean over each text's chunks."""
    last = first[1:] - 1
    chunks = np.maximum(blocks, np.concatenate([blocks[1:], np.zeros((1, blocks.shape[1]), blocks.dtype)]))
    chunks[last] = np.where((np.diff(first) == 1)[:, None], blocks[last], 0)  # a text's last block starts a chunk only if it is the first
    count = np.maximum(np.diff(first) - 1, 1)[:, None]
    return np.concatenate([np.maximum.reduceat(blocks, first[:-1]), np.add.reduceat(chunks.astype(np.float64), first[:-1]) / count], 1)


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    buffer, first = laid_out(*utf8(column))
    return sigmoid(combined(pooled_blocks(net, buffer, first), first) @ net.out.astype(np.float64) + float(net.start[0]))


def _gradients(net: Network, blocks: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted log loss. blocks: bytes of each block and of the WIDTH bytes after it."""
    number, places = len(blocks), np.arange(0, BLOCK, STRIDE)
    inputs = net.embed[blocks]
    windows = np.lib.stride_tricks.sliding_window_view(inputs.reshape(number, -1), WIDTH * DIM, axis=1)[:, :: STRIDE * DIM][:, : len(places)]
    z = np.ascontiguousarray(windows).reshape(-1, WIDTH * DIM) @ net.filters
    z = z.reshape(number, len(places), FILTERS)
    at = z.argmax(1)
    top = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias
    pooled = np.maximum(top, 0)
    x = combined(pooled, first).astype(pooled.dtype)
    error = ((sigmoid(x @ net.out + net.start[0]) - y) * weight / len(y)).astype(pooled.dtype)
    d_out, d_start = x.T @ error, np.array([error.sum()], pooled.dtype)
    dx = error[:, None] * net.out
    size = np.diff(first)
    text = np.repeat(np.arange(len(y)), size)
    d_pooled = np.where(pooled == x[text, :FILTERS], dx[text, :FILTERS], 0)
    share = dx[text, FILTERS:] / np.maximum(size - 1, 1)[text][:, None]
    head = np.ones(number, bool)
    head[first[1:] - 1] = size == 1  # blocks that start a chunk
    after = np.r_[1:number, number - 1]
    alone = (size == 1)[text]
    own = head[:, None] & ((pooled >= pooled[after]) | alone[:, None])
    d_pooled = d_pooled + np.where(own, share, 0)
    other = np.flatnonzero(head & ~alone)
    d_pooled[other + 1] += np.where(own[other], 0, share[other])
    d_pooled = np.where(top > 0, d_pooled, 0).astype(pooled.dtype)
    rows = np.arange(number)[:, None]
    chosen = windows[rows, at]  # number x FILTERS x WIDTH * DIM
    d_filters = np.einsum("nfk,nf->kf", chosen, d_pooled)
    d_window = (d_pooled[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
    used = blocks[np.arange(number)[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)].ravel()
    d_embed = np.stack([np.bincount(used, d_window[:, k], 257) for k in range(DIM)], 1).astype(pooled.dtype)
    return [d_embed, d_filters, d_pooled.sum(0), d_out, d_start]


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """texts: for each text its blocks, an array of as many rows as blocks and BLOCK + WIDTH columns. Both labels weigh alike up to a factor of 3."""
    net, r = fresh(seed), np.random.default_rng(seed)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    rare = np.clip(max(share, 1 - share) / min(share, 1 - share), 1, 3)
    weight = np.where((y == 1) == (share < 0.5), rare, 1.0).astype(np.float32)
    net.start[0] = np.log(share / (1 - share))
    first_moment, second_moment, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    steps = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            own = [texts[i] for i in rows]
            first = np.r_[0, np.cumsum([len(t) for t in own])]
            grads = _gradients(net, np.concatenate(own), first, y[rows].astype(np.float32), weight[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, m, v in zip(net.parts(), grads, first_moment, second_moment):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def text_blocks(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's blocks with the bytes that follow them."""
    buffer, first = laid_out(raw, starts)
    for a, b in zip(first[:-1], first[1:]):
        blocks = buffer[np.arange(a, b)[:, None] * BLOCK + np.arange(BLOCK + WIDTH)]
        blocks[-1, BLOCK:] = PAD
        yield blocks


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Network:
    """A network from the whole texts, of up to SAMPLE_BYTES, of at most `most` labelled rows that may be learned from. With
    none of either label it says their share."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            rows = [b.astype(np.int16).tobytes() for b in text_blocks(*utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "blocks"])

    rows = labelled_sample(docs, labels, column, most).where(F.octet_length("text") <= SAMPLE_BYTES).mapInArrow(cut, "doc_id bigint, label int, blocks binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    y = (rows.label.to_numpy() > 0).astype(np.float32)
    if not len(y) or y.min() == y.max():
        net = fresh()
        net.out[:] = 0
        net.start[0] = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return net
    return fit([np.frombuffer(b, np.int16).reshape(-1, BLOCK + WIDTH) for b in rows.blocks], y)


def score(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: a map over whole texts. Null texts count as empty; repeated rows and null ids come out as they go in."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 2 << 20):
            found = probabilities(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_rejected(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score below the threshold; a null text counts as empty."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 2 << 20):
            yield batch.filter(pa.array(probabilities(net, batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
