"""Alignment of the tokens of two tokenizers, and how often each pair of them is linked in the whole corpus.

Tokens of A (a byte-level BPE of the tokenizers library) and B (a sentencepiece model) over the same bytes end at cumulative
sums of their lengths. Ends that both have cut the bytes into groups; two tokens are linked if their byte ranges overlap. All
this is done by numpy over many words at once: cumsum for the ends, intersect1d for the common cuts, searchsorted for the
labels of the groups and for the first and last partner of each token, repeat to expand the links.

A text is cut before a space that stands between two letters. No token of either tokenizer crosses such a place: A's splitter
always starts a piece there, and no piece of B has a space after another character (``Aligner`` verifies this of the model, else texts stay whole). So words are
encoded and aligned once in a batch, and no text is too long: its words are taken by stretches.

The first pass writes each document's distinct linked pairs and their numbers as a table. Their totals are summed in two stages, first by pair and
salt, then by pair. The second pass joins them back: pairs that hold at least one part in ``HOT_PAIRS`` of all links, which are ``HOT_PAIRS`` at most,
by broadcast, all others by shuffle, so that no pair is a hot key there.

Edge cases: a text that is null, empty, or that either tokenizer does not give back byte for byte after a space has no tokens: zeros and an empty
``groups_sha256``. Strings of special tokens are plain text. Rows that repeat count each for itself; ids are carried as they are. An
empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import map_with_id, name, table, utf8, written

#: Pairs that are joined by broadcast: at most so many.
HOT_PAIRS = 1 << 18
SALTS = 16
#: Characters of text that a worker aligns at a time.
CHUNK = 1 << 19
#: Characters of words and of their groups, spelled out, that a worker remembers.
CACHE_CHARS = 32_000_000
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
CUT = re.compile(f"(?<=[{LETTERS}])(?= [{LETTERS}])")
#: A word that both tokenizers cut off from any such word before or after it.
JOINED = re.compile(f"(?s) [{LETTERS}](?:.*[{LETTERS}])?\\Z")
#: So many words are encoded as one text.
JOIN = 1000
BYTE = re.compile("<0x([0-9A-F]{2})>")


class Words:
    """Alignments of words: for each its numbers of tokens, groups and links, its groups spelled out (each with a semicolon after it), and its links one after the other."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.spelled: list[str] = []
        self.totals = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.links, self.starts, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.chars = 0

    def add(self, words: list[str], spelled: list[str], totals: np.ndarray, links: np.ndarray, bad: np.ndarray) -> None:
        for word in words:
            self.index[word] = len(self.index)
        self.spelled += spelled
        self.chars += sum(map(len, words)) + sum(map(len, spelled))
        self.starts = np.append(self.starts, len(self.links) + np.cumsum(totals[3]) - totals[3])
        self.totals, self.links, self.bad = np.append(self.totals, totals, axis=1), np.append(self.links, links), np.append(self.bad, bad)


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignments of words met before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in byte_letters().items()}
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else utf8(entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else utf8(p.replace("▁", " ")) for p in pieces]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_bits = len(pieces).bit_length()
        # A without a normaliser and with a token for each byte gives back whatever it is given
        self.lossless = self.a.normalizer is None and len({x for x in self.a_bytes if len(x) == 1}) == 256
        # each id as it is written within a group and at the end of its side of a group
        self.a_names, self.b_names = (tuple(np.array([f"{i}{c}" for i in range(n)], object) for c in ends) for n, ends in ((len(self.a_bytes), ",|"), (len(pieces), ",;")))
        self.words = Words()

    def split(self, text: str) -> list[str]:
        """The words of a text after the space that both tokenizers see before it. Each starts with a space."""
        return CUT.split(f" {text}") if self.cuts else [f" {text}"]

    def tokens(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Each text, which starts with a space, with its tokens of A and of B."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        for text, x, y in zip(texts, a, b, strict=True):
            yield text, np.array(x.ids, np.int64), np.array(y, np.int64)

    def gives_back(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        raw = utf8(text)
        return (
            self.a_sizes[a].sum() == self.b_sizes[b].sum() == len(raw)
            and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            and (self.lossless or b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw)
        )

    def encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The words in another order, their tokens of A and of B one after the other, and which words a tokenizer does not give back; these have no tokens.

        Words with letters at both ends are encoded many at a time, as neither tokenizer has a token across two of them.
        """
        whole = JOINED.match if self.cuts else lambda w: None
        plain, alone = [], []
        for w in words:
            (plain if whole(w) else alone).append(w)
        runs = [plain[i : i + JOIN] for i in range(0, len(plain), JOIN)]
        order, ids_a, ids_b, bad = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for run, (text, a, b) in zip(runs, self.tokens(list(map("".join, runs))), strict=True):
            if self.gives_back(text, a, b):
                order += run
                ids_a.append(a)
                ids_b.append(b)
            else:
                alone += run
        bad = [False] * len(order)
        for text, a, b in self.tokens(alone):
            fine = self.gives_back(text, a, b)
            order.append(text)
            bad.append(not fine)
            if fine:
                ids_a.append(a)
                ids_b.append(b)
        return order, np.concatenate(ids_a), np.concatenate(ids_b), np.array(bad, bool)

    def learn(self, words: list[str]) -> None:
        """Align new words, all at once."""
        words, ids_a, ids_b, bad = self.encoded(words)
        sizes = np.where(bad, 0, np.array([len(w.encode("utf-8", "replace")) for w in words], np.int64))
        stops = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        starts_a, starts_b = ends_a - self.a_sizes[ids_a], ends_b - self.b_sizes[ids_b]
        last_a, last_b = np.searchsorted(ends_a, stops, "right"), np.searchsorted(ends_b, stops, "right")
        n_a, n_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_groups = np.diff(np.searchsorted(cuts, stops, "right"), prepend=0)
        first = np.searchsorted(ends_b, starts_a, "right")
        partners = np.searchsorted(starts_b, ends_a, "left") - first
        links = np.repeat(ids_a, partners) << self.b_bits | ids_b[np.repeat(first - np.cumsum(partners) + partners, partners) + np.arange(partners.sum())]
        n_links = np.diff(np.append(0, np.cumsum(partners))[last_a], prepend=0)
        closes = [np.append(np.diff(g) > 0, True)[: len(g)] for g in (group_a, group_b)]
        names = np.concatenate([np.where(close, ends[ids], within[ids]) for close, ids, (within, ends) in zip(closes, (ids_a, ids_b), (self.a_names, self.b_names), strict=True)])
        parts = names[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        until = (last_a + last_b).tolist()
        spelled = ["".join(parts[i:j]) for i, j in zip([0, *until], until, strict=False)]
        self.words.add(words, spelled, np.stack([n_a, n_b, n_groups, n_links]), links, bad)

    def align(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, the groups with a semicolon after each, pairs, numbers of each text."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.words.index
        new = list({w for w in chain.from_iterable(split) if w not in known})
        if self.words.chars > CACHE_CHARS:
            self.words = Words()
            known, new = self.words.index, list(set(chain.from_iterable(split)))
        if new:
            self.learn(new)
        words = self.words
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        owner = np.repeat(np.arange(len(split)), np.diff(ends, prepend=0))
        spoilt = np.bincount(owner, words.bad[places], len(split)) > 0
        totals = [np.where(spoilt, 0, np.bincount(owner, x[places], len(split)).astype(np.int64)).tolist() for x in words.totals]
        many = words.totals[3][places]
        at = np.repeat(words.starts[places] - np.cumsum(many) + many, many) + np.arange(many.sum())
        bits = self.b_bits + len(self.a_bytes).bit_length()
        keys, numbers = np.unique(np.repeat(owner, many) << bits | words.links[at], return_counts=True)
        bounds = np.searchsorted(keys >> bits, np.arange(len(split) + 1))
        pairs = keys & (1 << bits) - 1
        pairs = pairs >> self.b_bits << 32 | pairs & (1 << self.b_bits) - 1
        out, begin = [], 0
        for i, end in enumerate(ends.tolist()):
            whole = not spoilt[i] and end > begin
            some = slice(bounds[i], bounds[i + 1]) if whole else slice(0, 0)
            spelled = "".join(map(words.spelled.__getitem__, places[begin:end].tolist())) if whole else ""
            out.append((*(x[i] for x in totals), spelled, pairs[some], numbers[some]))
            begin = end
        return out

    def align_long(self, text: str) -> tuple:
        """The same of one text of any length, by stretches of its words, with the hash of its groups."""
        digest, sums, held, size, total = hashlib.sha256(), np.zeros(4, np.int64), [], 0, {}
        words, between = self.split(text), b""
        for i, word in enumerate(words):
            held.append(word)
            size += len(word)
            if size >= CHUNK or i + 1 == len(words):
                part = self.align(["".join(held)[1:]])[0]
                if not part[0]:
                    return (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                digest.update(between + part[4][:-1].encode())
                between = b";"
                sums += np.array(part[:4])
                for pair, n in zip(part[5].tolist(), part[6].tolist(), strict=True):
                    total[pair] = total.get(pair, 0) + n
                held, size = [], 0
        pairs = np.array(sorted(total), np.int64)
        return (*sums.tolist(), digest.hexdigest(), pairs, np.array([total[p] for p in pairs.tolist()], np.int64))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker, which has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(a_path, b_path)


def runs(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts that are aligned together; a long one comes alone."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            if held:
                yield held
            yield [i]
            held, size = [], 0
            continue
        held.append(i)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, a key ``row``, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked ``pairs`` (A's id, 32 bits, B's id) with their ``numbers``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a_path, b_path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for some in runs(texts):
                if len(texts[some[0]]) > CHUNK:
                    rows = [both.align_long(texts[some[0]])]
                else:
                    rows = [(*x[:4], hashlib.sha256(x[4][:-1].encode()).hexdigest() if x[0] else "", *x[5:]) for x in both.align([texts[i] for i in some])]
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "numbers"])
                out.insert(0, "row", batch["row"].values[some])
                out.insert(0, "id", batch["id"].values[some])
                yield out

    rows = docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(name(text_col)).alias("text"))
    return map_with_id(rows, run, "row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, numbers array<bigint>")


def exploded(links: DataFrame) -> DataFrame:
    """row, pair, n."""
    return links.select("row", F.explode(F.arrays_zip("pairs", "numbers")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("n"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n (links in the whole corpus), best (no pair of its B id has more)."""
    salted = exploded(links).groupBy("pair", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    ids = counts.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n")
    return ids.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))  # a B id has as many rows as A has tokens at most


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Two tables: of each row id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the corpus's ``pair_counts``."""
    links = written(document_links(docs, a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model"), id_col, text_col))
    counts = written(pair_counts(links))
    known, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    score = counts.select("pair", F.col("n").alias("count"), "best")
    hot = F.broadcast(score if known <= hot_pairs else score.filter(F.col("count") >= (total or 0) / hot_pairs))
    marked = exploded(links).join(hot, "pair", "left")
    if known > hot_pairs:
        marked = marked.filter("count is not null").unionByName(marked.filter("count is null").select("row", "pair", "n").join(score, "pair"), allowMissingColumns=True)
    sums = marked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = links.select("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256"), counts


def default_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
