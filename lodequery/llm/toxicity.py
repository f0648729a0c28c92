"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its own hash and of its first four and five letters. Filters of widths
one to three run over the words of the whole text; each filter's maximum over the text enters a logistic output.
The first embedding axis starts as the evidence of a hash for either label (a z-score over documents), so that
max pooling looks at telling words from the start; embeddings, filters and output are then trained
together by gradient descent, in which only the winning windows carry a gradient.

Training reads every label row that may be learned from (crc32 of the id mod 3 is not 1) with its whole text, from one table that
joins both. A fifth of the documents, by a hash of the id, is held back to set the scale. Over the others the evidence is summed first; then each
task descends from the network so far on its own rows, and the next network is the mean of the tasks' networks, row by row
of the embeddings over the tasks that moved it. One pass over all rows is made, up to ``PASSES`` if fewer than ``ENOUGH`` rows
are met so. All outputs of the rows held back (of all rows, if a label is missing among those held back) are counted in steps of 1 / ``STEPS``;
the score is a logistic function of the output that passes 0.7 at the output that serves best there. A
threshold for each language with at least ``LANG_ROWS`` rows of either label is set likewise; it decides ``flagged`` and what
``drop_toxic`` rejects, and never enters the score. No threshold lets more than ``MOST_CLEAN`` of its clean rows pass.

Edge cases: a null text is empty; a text without words has the score of the output's bias. Label rows with a null or of
unknown documents are not used; a document with several label rows counts once for each, and each
row that repeats an id counts. Without labels of both kinds all scores are 0 and nothing is rejected. Rows that repeat an id each get a row. Extra columns of the input are not read.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, delete, durable, hot_keys, join_unique, map_batches, map_with_id, name, shared_folder, table

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 6, (1, 2, 3)
SAMPLE_CHARS = 20_000
LANG_ROWS = 15
BATCH, RATE, DECAY = 32, 0.03, 1e-5
PASSES, ENOUGH = 4, 20_000
TASK_ROWS = 4_000  # rows that a task descends on, at least
STEPS, FAR = 1 << 10, 64  # outputs are counted in steps of 1 / STEPS up to FAR
LINE = 0.7
PIECES = 16  # tasks, at most, that send a network's rows to the driver
MOST_CLEAN = 0.02  # of the clean rows held back, at most this share may pass the line
CACHE_WORDS = 250_000
CHANNELS = sum(WIDTHS) * FILTERS
APART = bytes(32 if chr(b) in "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c" else b for b in range(256))


def words_of(text: str | None) -> list[str]:
    plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(APART)
    return list(filter(None, plain.decode("utf-8", "surrogatepass").split(" ")))


def bucket(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace")) % BUCKETS


@lru_cache(maxsize=1 << 17)
def prefix_bucket(key: str) -> int:
    return bucket(key)


def buckets_of(word: str) -> tuple[int, int, int]:
    """The hashes of a word and of its two prefixes."""
    return bucket("w" + word), prefix_bucket("4" + word[:4]), prefix_bucket("5" + word[:5])


class Words:
    """Numbers the words of texts; ``table`` has the buckets of each number. Emptied when it holds CACHE_WORDS."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((4096, 3), np.int64)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        docs = [words_of(t) for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.place.clear()
        fresh = list({w for doc in docs for w in doc if w not in self.place})
        first = len(self.place)
        while len(self.table) < first + len(fresh):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if fresh:
            self.table[first : first + len(fresh)] = [buckets_of(w) for w in fresh]
        self.place.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return [np.fromiter(map(self.place.__getitem__, doc), np.int64, len(doc)) for doc in docs]


class Network:
    """Embeddings, filters (one matrix of DIM x CHANNELS; a filter of width k has k slices) and the output."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.1, (DIM, CHANNELS)).astype(np.float32)
        self.filters[0] = 0.25
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.bias = np.float32(-2.0)
        self.slope, self.line = 1.0, 0.0
        self.by_lang: dict[str, float] = {}
        self.trained = False

    def slices(self) -> Iterator[tuple[int, int, list[int]]]:
        """(group, width, first channel of each slice)."""
        channel = 0
        for group, width in enumerate(WIDTHS):
            yield group, width, [channel + k * FILTERS for k in range(width)]
            channel += width * FILTERS

    def pooled(self, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over a text (not below zero) and where it is; -1 where there is none."""
        top = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        where = np.full(len(top), -1)
        for group, width, first in self.slices():
            n = len(projected) - width + 1
            if n <= 0:
                continue
            seen = projected[:n, first[0] : first[0] + FILTERS]
            for k in range(1, width):
                seen = seen + projected[k : n + k, first[k] : first[k] + FILTERS]
            at = seen.argmax(axis=0)
            value = seen[at, np.arange(FILTERS)] + self.shift[group * FILTERS : (group + 1) * FILTERS]
            on = value > 0
            top[group * FILTERS : (group + 1) * FILTERS] = np.where(on, value, 0)
            where[group * FILTERS : (group + 1) * FILTERS] = np.where(on, at, -1)
        return top, where

    def state(self) -> np.ndarray:
        """All that is trained, in rows of DIM: the embeddings, then the rest."""
        rest = np.concatenate([self.filters.ravel(), self.shift, self.out, [self.bias]])
        return np.concatenate([self.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def put(self, state: np.ndarray) -> None:
        own = len(WIDTHS) * FILTERS
        self.embed, rest = state[:BUCKETS].astype(np.float32), state[BUCKETS:].ravel().astype(np.float32)
        parts = np.split(rest, np.cumsum([DIM * CHANNELS, own, own, 1]))
        self.filters, self.shift, self.out, self.bias = parts[0].reshape(DIM, CHANNELS), parts[1], parts[2], parts[3][0]

    def winners(self, docs: list[np.ndarray], table_of: np.ndarray, piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` of each document; long ones by overlapping pieces."""
        top = np.zeros((len(docs), len(self.out)), self.filters.dtype)
        where = np.full(top.shape, -1)
        for i, doc in enumerate(docs):
            for at in range(0, len(doc), piece):
                met = table_of[doc[at : at + piece + max(WIDTHS) - 1]].T
                value, place = self.pooled((self.embed[met[0]] + self.embed[met[1]] + self.embed[met[2]]) @ self.filters)
                better = value > top[i]
                top[i, better], where[i, better] = value[better], place[better] + at
        return top, where

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, table_of: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss of some documents (word numbers), with the embedding rows they touch; only winning windows carry any."""
        top, where = self.winners(docs, table_of)
        error = (1 / (1 + np.exp(-(top @ self.out + self.bias))) - labels) * weight
        back = np.where(where >= 0, error[:, None] * self.out, 0)
        flat, begin = np.concatenate(docs), np.cumsum([0, *map(len, docs[:-1])])
        g_filters, rows, parts = np.zeros_like(self.filters), [np.empty((0, 3), np.int64)], []
        for group, width, first in self.slices():
            doc, f = np.nonzero(where[:, group * FILTERS : (group + 1) * FILTERS] >= 0)
            j = group * FILTERS + f
            own = back[doc, j][:, None]
            for k in range(width):
                met = table_of[flat[begin[doc] + where[doc, j] + k]]
                np.add.at(g_filters.T, first[k] + f, (own * self.embed[met].sum(axis=1)).astype(g_filters.dtype))
                rows.append(met)
                parts.append(own * self.filters.T[first[k] + f])
        distinct, inverse = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
        total = np.zeros((len(distinct), DIM), np.float32)
        np.add.at(total, inverse, np.repeat(np.concatenate(parts).astype(np.float32), 3, axis=0))
        return {"filters": g_filters, "shift": back.sum(axis=0), "out": error @ top, "bias": error.sum(), "rows": distinct, "embed": total}

    def rejected(self, outputs: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """Which outputs reach the line of their language, or the common one where it has none."""
        lines = np.array([self.by_lang.get(x, self.line) for x in langs], np.float64)
        return (outputs >= lines) & self.trained

    def score(self, output: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(output))
        return 1 / (1 + np.exp(-np.clip(self.slope * (output - self.line) + np.log(LINE / (1 - LINE)), -40, 40)))

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Applies a network to texts, with a bounded cache of projected words."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.projected = np.empty((4096, CHANNELS), np.float32)

    def learn(self, words: list[str]) -> None:
        first = len(self.place)
        while len(self.projected) < first + len(words):
            self.projected = np.concatenate([self.projected, np.empty_like(self.projected)])
        net = self.network
        self.projected[first : first + len(words)] = net.embed[np.array([buckets_of(w) for w in words])].sum(axis=1) @ net.filters
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def outputs(self, texts: list[str | None], piece: int = 1 << 16, most: int = 1 << 17) -> np.ndarray:
        """The network's output for each whole text, pooled for many texts at once; long ones go by overlapping pieces, whose maxima combine."""
        best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        parts: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, len(words), piece):
                parts.append((i, words[at : at + piece + max(WIDTHS) - 1]))
                size += len(parts[-1][1])
                if size >= most:
                    self.pool(parts, best)
                    parts, size = [], 0
        self.pool(parts, best)
        return (best @ self.network.out + self.network.bias).astype(np.float64)

    def pool(self, parts: list[tuple[int, list[str]]], best: np.ndarray) -> None:
        """Raise the maxima of each text by those of its parts."""
        if not parts:
            return
        fresh = {w for _, part in parts for w in part if w not in self.place}
        if len(self.place) + len(fresh) > CACHE_WORDS:
            self.clear()
            fresh = {w for _, part in parts for w in part}
        if fresh:
            self.learn(list(fresh))
        owner, sizes = np.array([i for i, _ in parts]), np.array([len(p) for _, p in parts])
        flat = self.projected[np.fromiter((self.place[w] for _, part in parts for w in part), np.int64, sizes.sum())]
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(ends[-1])  # words from here to the end of the part
        for group, width, first in self.network.slices():
            n = len(flat) - width + 1
            if n <= 0:
                continue
            seen = np.full((len(flat), FILTERS), -np.inf, np.float32)
            seen[:n] = flat[:n, first[0] : first[0] + FILTERS]
            for k in range(1, width):
                seen[:n] += flat[k : n + k, first[k] : first[k] + FILTERS]
            seen[left < width] = -np.inf  # windows over the end of a part
            own = slice(group * FILTERS, (group + 1) * FILTERS)
            np.maximum.at(best[:, own], owner, np.maximum.reduceat(seen, ends - sizes) + self.network.shift[own])


class Descent:
    """Gradient descent of a network on batches of texts, with its own step sizes."""

    def __init__(self, network: Network, share: float, seed: int = 3) -> None:
        self.network, self.share, self.words, self.rng = network, share, Words(), np.random.default_rng(seed)
        self.square = {k: np.full_like(getattr(network, k), 1e-2) for k in ("filters", "shift", "out", "embed")}

    def step(self, part: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.square[part][rows] += gradient**2
        getattr(self.network, part)[rows] -= RATE * gradient / np.sqrt(self.square[part][rows])

    def learn(self, texts: list[str | None], bad: np.ndarray, clean: np.ndarray) -> None:
        """One pass over texts with their numbers of toxic and clean label rows."""
        docs, net = self.words.numbers(texts), self.network
        bad, clean = bad * 0.5 / self.share, clean * 0.5 / (1 - self.share)
        order = self.rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            weight = bad[part] + clean[part]
            own = net.gradients([docs[i] for i in part], bad[part] / weight, weight / BATCH, self.words.table)
            self.step("filters", own["filters"] + DECAY * net.filters)
            self.step("shift", own["shift"])
            self.step("out", own["out"] + DECAY * net.out)
            net.bias -= np.float32(RATE * own["bias"])
            if len(own["rows"]):
                self.step("embed", own["embed"], own["rows"])


def guarded_line(z: np.ndarray, bad: np.ndarray, clean: np.ndarray) -> float:
    """The best line, raised until at most MOST_CLEAN of the clean rows pass. ``z`` falls; both kinds are counted at each."""
    line, below = best_line(z, bad, clean), np.cumsum(clean[::-1])
    if not below.size or not below[-1]:
        return line
    most = np.searchsorted(below, np.ceil((1 - MOST_CLEAN) * (below[-1] - 1)) + 1)
    return max(line, float(z[::-1][most]) + 0.5 / STEPS + 1e-6)


def best_line(z: np.ndarray, bad: np.ndarray, clean: np.ndarray) -> float:
    """The cut with the best F1, in the middle of its gap; above everything without positives."""
    if not len(z) or not bad.sum():
        return float(z[0] + 1) if len(z) else 0.0
    f1 = 2 * np.cumsum(bad) / (np.cumsum(bad + clean) + bad.sum())
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 0.5 / STEPS - 1e-3)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """text, toxic, lang and a hash of at most ``most`` rows of each label that may be learned from: a table for trials, of which ``fit`` makes no use."""
    own = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("toxic"))
    open_ = own.filter("_label_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("_label_id").cast("string")) % 3 != 1).withColumn("h", F.xxhash64(F.col("_label_id").cast("string")))
    picked = None
    for label in (0, 1):
        part = open_.filter(F.col("toxic") == label).orderBy("h", "_label_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col(name(text_col))
    texts = docs.filter(text.isNull() | (F.length(text) <= SAMPLE_CHARS)).select(F.col(name(id_col)).alias("_label_id"), text.alias("text"), lang.alias("lang"))
    found = texts.join(F.broadcast(picked), "_label_id")
    both = [found.filter(F.col("toxic") == label).orderBy("h", "text").limit(2 * most) for label in (0, 1)]
    return both[0].unionByName(both[1]).select("text", "toxic", "lang", "h")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, lang, bad and clean (numbers of label rows) and back (held back to set the scale) of every row that may be learned from."""
    may = lambda c: F.crc32(c.cast("string")) % 3 != 1
    own = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter("_label_id is not null and toxic in (0, 1)").filter(may(F.col("_label_id")))
    counts = own.groupBy("_label_id").agg(F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("clean"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(name(id_col)).alias("_label_id"), F.col(name(text_col)).alias("text"), lang.alias("lang")).filter(may(F.col("_label_id")))
    hot = hot_keys(texts.select("_label_id"), ["_label_id"])
    # by shuffle at any size: texts move once, and no label table is broadcast
    found = texts.join(counts.hint("merge"), "_label_id") if hot is None else join_unique(texts, counts, ["_label_id"], hot=hot)
    back = F.pmod(F.shiftright(F.xxhash64(F.col("_label_id").cast("string")), 7), F.lit(5)) == 0
    return found.select("text", "lang", "bad", "clean", back.alias("back"))


def evidence(rows: DataFrame) -> DataFrame:
    """(bucket, met, bad): label rows of the documents that have a bucket, and the toxic ones of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, met, bad = Words(), np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for doc, b, c in zip(words.numbers(batch["text"].tolist()), batch["bad"], batch["clean"], strict=True):
                own = np.unique(words.table[doc])
                met[own] += b + c
                bad[own] += b
        at = np.flatnonzero(met)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "met": met[at], "bad": bad[at]})

    made = map_batches(rows.select("text", "bad", "clean"), run, "bucket int, met double, bad double")
    return made.groupBy("bucket").agg(F.sum("met").alias("met"), F.sum("bad").alias("bad"))


def moved(rows: DataFrame, shared: Broadcast, share: float) -> DataFrame:
    """(at, d0, ...): how far the tasks moved each row of the network's state, in the mean of those that moved it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        descent, n, before = Descent(copy.deepcopy(shared.value), share), 0, shared.value.state()
        for batch in batches:
            descent.learn(batch["text"].tolist(), batch["bad"].to_numpy(), batch["clean"].to_numpy())
            n += len(batch)
        by = descent.network.state() - before
        at = np.flatnonzero(by.any(axis=1))
        yield pd.DataFrame({"at": at.astype(np.int32), "n": np.full(len(at), float(n))} | {f"d{k}": by[at, k].astype(np.float32) for k in range(DIM)})

    columns = [f"d{k}" for k in range(DIM)]
    made = map_batches(rows.select("text", "bad", "clean"), run, "at int, n double, " + ", ".join(f"{c} float" for c in columns))
    return made.groupBy("at").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns])


def gathered(parts: DataFrame, pieces: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where and what ``pieces`` makes of each batch of ``parts``, in tasks; the driver gets a piece for each batch.

    A whole network as one object is copied several times on its way; a burst of those makes the driver's heap grow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, value in pieces(batches):
            if len(at):
                yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "value": [value.astype(np.float32).tobytes()]})

    for row in map_batches(parts.coalesce(PIECES), run, "at binary, value binary").collect():
        yield np.frombuffer(row["at"], np.int32), np.frombuffer(row["value"], np.float32)


def begin(rows: DataFrame, network: Network, share: float) -> None:
    """Set the network's first axis to the evidence of ``rows``."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in batches:
            met, bad = part["met"].to_numpy(), part["bad"].to_numpy()
            yield part["bucket"].to_numpy(), np.clip((bad - met * share) / np.sqrt(met * share * (1 - share) + 2), -6, 6)

    network.embed[:, 0] = 0
    for at, value in gathered(evidence(rows), pieces):
        network.embed[at, 0] = value


def descend(rows: DataFrame, network: Network, share: float) -> None:
    """One pass over ``rows``: the network becomes the mean of the tasks' networks."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        before = shared.value.state()
        for part in batches:
            at = part["at"].to_numpy()
            yield at, before[at] + part[[f"d{k}" for k in range(DIM)]].to_numpy()

    state = network.state()
    for at, value in gathered(moved(rows, shared, share), pieces):
        state[at] = value.reshape(-1, DIM)
    network.put(state)
    shared.destroy()


def calibrated(rows: DataFrame, network: Network) -> Network:
    """Set the line between the labels overall and by language, and the slope of the score, by the outputs of all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared.value.reader()
        for batch in batches:
            z = np.clip(reader.outputs(batch["text"].tolist()), -FAR, FAR)
            yield batch[["lang", "bad", "clean"]].assign(z=np.rint(z * STEPS) / STEPS)

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values("z", ascending=False)
        z, bad, clean = (own[c].to_numpy() for c in ("z", "bad", "clean"))
        spread = np.sqrt(np.cov(z, aweights=bad + clean, ddof=0)) if len(z) > 1 else 0.0
        yield pd.DataFrame({"line": [guarded_line(z, bad, clean)], "slope": [np.clip(4.0 / (spread or 1.0), 0.2, 20)]})

    def of_lang(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("z", ascending=False)
        lines = [guarded_line(*(own[c].to_numpy() for c in ("z", "bad", "clean")))] if min(own["bad"].sum(), own["clean"].sum()) >= LANG_ROWS else []
        return pd.DataFrame({"lang": own["lang"].iloc[: len(lines)], "line": lines})

    sums = [F.sum(c).alias(c) for c in ("bad", "clean")]
    made = map_batches(rows.select("text", "lang", "bad", "clean"), outputs, "lang string, bad double, clean double, z double")
    counts = durable(made.groupBy("lang", "z").agg(*sums).coalesce(PIECES))  # at most one row for each step and language
    shared.destroy()
    network.line, network.slope = map_batches(counts.groupBy("z").agg(*sums).repartition(1), common, "line double, slope double").first()
    network.by_lang = {r.lang: r.line for r in counts.filter("lang is not null").groupBy("lang").applyInPandas(of_lang, "lang string, line double").collect()}
    return network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network trained and calibrated on all labelled rows that may be learned from."""
    spark, network = docs.sparkSession, Network()
    path = f"{shared_folder(spark).rstrip('/')}/lodequery-{uuid.uuid4().hex}"
    labelled(docs, labels, id_col, text_col).write.parquet(path)
    try:
        rows = spark.read.parquet(path)
        totals = {r.back: r for r in rows.groupBy("back").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n")).collect()}
        own, held = totals.get(False), totals.get(True)
        if own is None or not own.bad or not own.clean:
            return network
        share = own.bad / (own.bad + own.clean)
        learn = rows.filter("not back").coalesce(max(1, own.n // TASK_ROWS))
        begin(learn, network, share)
        for _ in range(min(PASSES, max(1, -(-ENOUGH // own.n)))):
            descend(learn, network, share)
        network.trained = True
        return calibrated(rows.filter("back") if held and held.bad and held.clean else rows, network)
    finally:
        delete(spark, path)


def judge(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted, and flagged by the language's own threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared.value.reader()
        for batch in batches:
            outputs = reader.outputs(batch["text"].tolist())
            score = shared.value.score(outputs)
            flagged = shared.value.rejected(outputs, batch["lang"].tolist())
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= LINE).astype(np.int32), "flagged": flagged})

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    held_out = F.coalesce(F.crc32(F.col(name(id_col)).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.col(name(text_col)).alias("text"), lang.alias("lang"), held_out.alias("held_out"))
    return map_with_id(rows, run, "held_out boolean, score double, predicted int, flagged boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay under the line of their language, all columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            langs = batch.column(batch.schema.names.index("lang")).to_pylist() if "lang" in batch.schema.names else [None] * len(texts)
            yield batch.filter(pa.array(~shared.value.rejected(reader.outputs(texts), langs)))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels))


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
