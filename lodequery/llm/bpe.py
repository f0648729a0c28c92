"""BPE encoding and decoding by speculation: greedy longest match, vectorised pair checks, exact merging of the rest.

A word's greedy longest-match split is the BPE split if every token merges to itself and every two
neighbours, merged on their own, stay as they are. Words that are new to a worker are split greedily
in one go; all adjacent pairs of them are tested at once against the sorted table of known pairs
(pairs not met before are merged exactly, once); only words with a failing pair are merged exactly.

Text is composed, lower-cased and cut into words as the file's own normaliser and splitter do. For the characters of
``COMMON``, on which all Unicode versions agree, that is done here; a text with any other character is normalised by
the file's normaliser, and the file's splitter is asked once, for each new character of a worker, whether it is a letter, a
number, a space or none of these.

Edge cases: null is the empty text, which has no tokens; the hash is then that of the empty string.
The strings of special tokens in a text give their ids. Any length of text or word is processed whole: long words
are merged with a heap, in n log n steps. When the words that a worker met hold half of ``CACHE_CHARS`` characters, they
become its old words, and those that were old and not met again are forgotten. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_with_id, name, table, utf8

CACHE_CHARS = 2_500_000
#: Letters by which tokens are looked up in the longest match.
HEAD = 4
#: Words of more symbols than this are merged with a heap.
LONG = 48
#: A merge is one number: its rank, and the token it makes in the lowest bits.
TOKEN_BITS = 32
NEVER = 1 << 62
TOKEN = (1 << TOKEN_BITS) - 1
NO_HALVES = (-1, 0, 0)
CACHE_PAIRS = 2_000_000
#: Characters of text that are split into words at a time.
CHUNK = 1 << 20
#: Characters of text whose results a worker hands on at a time.
OUT_CHARS = 1 << 22
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_ASCII = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
WORD = regex.compile(rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")
#: Composed, with the same class and lower case in every version: Latin, punctuation, Cyrillic, kana, ideographs, Hangul syllables.
COMMON = "\x20-\x7e\t\n\r\xa1-\u0233\u2010-\u2027\u2030-\u205e\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
UNCOMMON = re.compile(f"[^{COMMON}]")
#: What a character stands for while words are cut, by its class: a letter of no contraction, a number, a space, a sign.
STAND_IN = {"letter": "é", "number": "1", "space": " ", "sign": "#"}


class Characters:
    """Normalisation and character classes of a tokenizers file."""

    def __init__(self, spec: dict) -> None:
        bare = spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}
        library = Tokenizer.from_str(json.dumps(bare))  # the vocabulary is read once, by the Speculator
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.met: set[str] = set()
        self.stand_in: dict[int, str] = {}

    def kind(self, character: str) -> str:
        """How the file's splitter treats a character, seen from the pieces of an a followed by it twice."""
        pieces = self.splitter.pre_tokenize_str(f"a{character}{character}")
        if len(pieces) == 1:
            return "letter" if len(pieces[0][0]) > 1 else "space"
        return "number" if len(pieces) == 3 else "sign"

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        if text.isascii() and not UNCOMMON.search(text):
            return WORD_ASCII.findall(text.lower())
        if not UNCOMMON.search(text):
            return WORD.findall(text.lower())
        plain = self.normalizer.normalize_str(text)
        for c in set(plain) - self.met:
            self.met.add(c)
            self.stand_in[ord(c)] = c if c.isascii() and c.isprintable() else STAND_IN[self.kind(c)]
        return [plain[m.start() : m.end()] for m in WORD.finditer(plain.translate(self.stand_in))]


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def stretches(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts; a run ends with the text that brings it to ``most`` characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def starts(vocab: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """The lengths, longest first, that tokens with the same first four letters have; shorter tokens are in the lists they begin."""
    found: dict[str, set[int]] = {}
    for token in vocab:
        found.setdefault(token[:HEAD], set()).add(len(token))
    return {head: tuple(sorted(own | {k for k in range(1, len(head)) if head[:k] in vocab}, reverse=True)) for head, own in found.items()}


class Speculator:
    """Word-level BPE with an end-of-word suffix, read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): rank << TOKEN_BITS | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.longest = max(len(t) for t in self.vocab)
        self.sizes = starts(self.vocab)
        self.halves = self.origins()
        self.letters = byte_letters()
        self.inner, self.final = ({b: self.vocab.get(c + end) for b, c in self.letters.items()} for end in ("", self.suffix))
        self.characters = Characters(spec)
        self.held = 0
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.stable: dict[int, bool] = {}
        self.pairs, self.fit = np.empty(0, np.int64), np.empty(0, bool)
        self.spelled = {i: str(i) for i in self.names}
        self.known: dict[str, tuple[str, str]] = {}  # ids and tokens of a word
        self.old: dict[str, tuple[str, str]] = {}

    def symbols(self, word: str) -> list[str]:
        letters = list(word) if word.isalnum() and word.isascii() else [self.letters[b] for b in word.encode("utf-8", "replace")]
        letters[-1] += self.suffix
        return letters

    def atoms(self, token: int) -> list[int]:
        """The single-letter tokens of a token."""
        name = self.names[token]
        ended = len(name) > len(self.suffix) and name.endswith(self.suffix)
        letters = list(name[: -len(self.suffix)] if ended else name)
        if ended:
            letters[-1] += self.suffix
        return [self.vocab[x] for x in letters if x in self.vocab]

    def origins(self) -> dict[int, tuple[int, int, int] | None]:
        """(rank, left, right) of the merge that makes a token; None if several do, or if a part of it is merged later than it."""
        made: dict[int, tuple[int, int, int] | None] = {}
        for (left, right), merge in self.merges.items():
            rank, token = merge >> TOKEN_BITS, merge & TOKEN
            made[token] = None if token in made else (rank, left, right)
        early = lambda x, rank: x not in made or made[x] is not None and made[x][0] < rank
        return {t: m if m and early(m[1], m[0]) and early(m[2], m[0]) else None for t, m in made.items()}

    def apart(self, left: int, right: int) -> bool | None:
        """Whether two tokens that merge to themselves stay apart; None if their origins do not tell.

        Their merges are undone from the last to the first (of one rank the left one comes first). While the two tokens that touch
        are there, they merge if their rank is below that of the next merge of the left one, and not above that of the right one.
        """
        get, halves, below, upto = self.merges.get, self.halves, None, None
        while True:
            met = get((left, right))
            if met is not None and (below is None or met >> TOKEN_BITS < below) and (upto is None or met >> TOKEN_BITS <= upto):
                return False
            a, b = halves.get(left, NO_HALVES), halves.get(right, NO_HALVES)
            if a is None or b is None:
                return None
            if a is NO_HALVES and b is NO_HALVES:
                return True
            if a[0] > b[0]:
                below, left = a[0], a[2]
            else:
                upto, right = b[0], b[1]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: the lowest-ranked pair first, leftmost on a tie."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        parts, get = list(parts), self.merges.get
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [best & TOKEN]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for many symbols: a linked list, and a heap of candidate pairs of which outdated ones are skipped."""
        parts, get, n = list(parts), self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found >> TOKEN_BITS, i, parts[i], parts[i + 1], found & TOKEN) for i in range(n - 1) if (found := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get((merged, parts[k]))) is not None:
                    heapq.heappush(heap, (found >> TOKEN_BITS, i, merged, parts[k], found & TOKEN))
            if (h := before[i]) >= 0 and (found := get((parts[h], merged))) is not None:
                heapq.heappush(heap, (found >> TOKEN_BITS, h, parts[h], merged, found & TOKEN))
        return [p for p in parts if p >= 0]

    def exact(self, word: str) -> list[int]:
        *inner, final = word.encode("utf-8", "replace")
        return self.merge([x for x in [*map(self.inner.__getitem__, inner), self.final[final]] if x is not None])

    def greedy(self, word: str) -> list[int] | None:
        """Longest-match split; None if some letter has no token."""
        text = "".join(self.symbols(word))
        size, last, at, out = len(text), len(text) - len(self.suffix), 0, []
        while at < size:
            if at < last and last - at <= self.longest and (whole := self.vocab.get(text[at:])) is not None:
                out.append(whole)
                break
            head = text[at : at + HEAD]
            while (sizes := self.sizes.get(head)) is None and len(head) > 1:
                head = head[:-1]
            for size_of in sizes or ():
                if (end := at + size_of) <= last and (found := self.vocab.get(text[at:end])) is not None:
                    break
            else:
                return None
            if end == last:  # the last letter carries the suffix, so no token may end just before it
                for end in range(last - 1, at, -1):
                    if (found := self.vocab.get(text[at:end])) is not None:
                        break
                else:
                    return None
            out.append(found)
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each key (left << 32 | right): whether the two tokens stay as they are next to each other."""
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, distinct), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == distinct if len(self.pairs) else np.zeros(len(distinct), bool)
        new = distinct[~known]
        if len(new):
            fit = np.empty(len(new), bool)
            for i, key in enumerate(new.tolist()):
                pair = [key >> 32, key & 0xFFFFFFFF]
                fit[i] = self.itself(pair[0]) and self.itself(pair[1]) and self.stay(*pair)
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs, self.fit = np.empty(0, np.int64), np.empty(0, bool)
                return self.compatible(keys)
            slot = np.searchsorted(self.pairs, new)
            self.pairs, self.fit = np.insert(self.pairs, slot, new), np.insert(self.fit, slot, fit)
        return self.fit[np.searchsorted(self.pairs, distinct)][place]

    def stay(self, left: int, right: int) -> bool:
        """Whether two tokens that merge to themselves do so next to each other."""
        found = self.apart(left, right)
        return self.merge(self.atoms(left) + self.atoms(right)) == [left, right] if found is None else found

    def itself(self, token: int) -> bool:
        if token not in self.stable:
            self.stable[token] = self.merge(self.atoms(token)) == [token]
        return self.stable[token]

    def learn(self, words: list[str]) -> None:
        """Put the split of each word into the cache."""
        splits = [self.greedy(w) for w in words]
        keys, owner = [], []
        for n, split in enumerate(splits):
            if split is not None:
                for pair in zip(split, split[1:], strict=False):
                    keys.append(pair[0] << 32 | pair[1])
                    owner.append(n)
        failed = {n for n, s in enumerate(splits) if s is None or len(s) == 1 and not self.itself(s[0])}
        if keys:
            failed.update(np.asarray(owner)[~self.compatible(np.asarray(keys, np.int64))].tolist())
        spelled, names = self.spelled, self.names
        for n, word in enumerate(words):
            split = self.exact(word) if n in failed else splits[n]
            self.known[word] = " ".join([spelled[i] for i in split]), " ".join([names[i] for i in split])

    def words(self, text: str) -> list[str]:
        """The words of one stretch of text without special tokens."""
        return self.characters.words(text)

    def pieces(self, text: str) -> list[tuple[str | None, list[str]]]:
        """(special token or None, words) of each stretch of a text."""
        if "<|" not in text:
            return [(None, self.words(text))]
        return [(x, []) if x in self.special else (None, self.words(x)) for x in self.splitter.split(text)]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, tokens) of each text, each joined by one space. New words of many texts are learnt together."""
        for first, last in stretches(texts, CHUNK):
            split = [self.pieces(t) for t in texts[first:last]]
            if self.held > CACHE_CHARS // 2:
                self.old, self.known, self.held = self.known, {}, 0
            known, old = self.known, self.old
            found = [[(special, words, list(map(known.get, words))) for special, words in pieces] for pieces in split]
            fresh = {w for pieces in found for _, words, own in pieces for w, x in zip(words, own, strict=True) if x is None}
            self.held += sum(map(len, fresh))
            kept = fresh & old.keys()
            known.update((w, old.pop(w)) for w in kept)
            self.learn(list(fresh - kept))
            for pieces in found:
                ids, tokens = [], []
                for special, words, own in pieces:
                    if special is not None:
                        ids.append(self.spelled[self.special[special]])
                        tokens.append(special)
                    own = [x or known[w] for w, x in zip(words, own, strict=True)]
                    ids += [x[0] for x in own]
                    tokens += [x[1] for x in own]
                yield " ".join(filter(None, ids)), " ".join(filter(None, tokens))


@lru_cache(maxsize=1)
def speculator(path: str) -> Speculator:
    """One for each worker, with its cache."""
    return Speculator(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id, n_tokens, digests of the token ids and of the decoded text, and of these two (array, text) those that ``outputs`` names."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = speculator(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, end in stretches(texts, OUT_CHARS):
                rows = []
                for ids, decoded in model.encode_batch(texts[first:end]):
                    n = ids.count(" ") + 1 if ids else 0
                    whole = [np.fromstring(ids, np.int32, sep=" ") if x == "ids" else decoded for x in outputs]
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(utf8(decoded)).hexdigest(), *whole))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *outputs])
                out.insert(0, "id", batch["id"].values[first:end])
                yield out

    types = {"ids": "array<int>", "decoded": "string"}
    schema = ", ".join(["n_tokens bigint, ids_sha256 string, decoded_sha256 string", *[f"{x} {types[x]}" for x in outputs]])
    return map_with_id(docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.col(name(text_col)).alias("text")), run, schema).withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), outputs=())


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
