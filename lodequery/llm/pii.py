"""Personal data: base patterns, and a skip-chain conditional random field for mentions the patterns miss.

The base patterns give e-mail addresses, IP addresses, card and phone numbers. The field labels the tokens (runs without white
space) around digits, at signs and spelled-out addresses with one of these kinds, ``secret`` (keys and tokens) or none. Neighbouring tokens
form a chain; tokens of the same value (digits of a run of numbers, an address in plain form, a long literal) and, apart, numbers of the same
last seven digits are tied by skip edges however far apart: every mention to the first, so any two are two edges apart. Tokens of
base spans have a known label. Loopy sum-product messages run until they settle; neighbouring tokens of one label become an
added span if their marginals reach ``CERTAIN``, if the mention is plausible for its kind, and if it overlaps no base span.

Training: potentials of tokens (hashed shapes, words and neighbours), of the chain and of either skip edge are learnt together by
pseudo-likelihood (each token given its neighbours' labels). Labels come from the base spans of a bounded sample; secrets from
assignments such as ``token = "..."``. So that the field finds what the patterns miss, each document also enters
in a masked form: half its base spans are rewritten as people write around patterns (no plus and country code, ``name at host dot com``,
``1[.]2[.]3[.]4``, groups with dots) with their labels kept. Candidates of unknown label (numbers of 9 to 15 digits, spelled addresses) do not
train; card-like numbers that fail the checksum are known to be none.

Work is linear in the text: patterns start only where they can match, and edges join a mention to its neighbours and its first.

Edge cases: null is the empty text and has no spans; the digest is then that of the empty string. Rows that
repeat an id each get a row. Without any base span to train on, the field adds nothing. Extra columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_with_id, name, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
ORDER = {k: i for i, k in enumerate(LABELS)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]")
SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64})(?: at | ?[\[(]at[\])] ?)([A-Za-z0-9-]{1,63}(?:(?:\.| dot | ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){1,4})")
SECRET = re.compile(r"(?i)\b(?:token|key|secret|password|passwd|pwd)[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_-]{16,})")
DOTTED = re.compile(r"[0-9]{1,3}(?:\[?\.\]?|\[dot\])[0-9]{1,3}(?:\[?\.\]?|\[dot\])[0-9]{1,3}(?:\[?\.\]?|\[dot\])[0-9]{1,3}")
SAMPLE_DOCS = 1_000  # documents the field is trained on, at most
SAMPLE_CHARS = 20_000  # and the longest text among them, which bounds the sample
CERTAIN = 0.9
HASHED = 1 << 14
REACH = 2  # tokens on either side of a token of interest
ROUNDS, SETTLED = 100, 1e-5
CHUNK = 1 << 20  # characters of text in one graph, or one text
EDGES = ("chain", "same", "similar")
STRIP = "\"'`.,;:!?[]{}<>#*&%$=|~_"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @: the run of local characters before it, as far as the last match, and a domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        floor = max(floor, at + 1)
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed. A match that fails its test is dropped, with no second try."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain(value: str) -> str:
    """The address that equal spellings share."""
    spelled = re.sub(r" at | ?[\[(]at[\])] ?", "@", value)
    return re.sub(r" dot | ?[\[(]dot[\])] ?", ".", spelled).lower()


def shape(token: str) -> str:
    """The token with runs of digits as their number and runs of letters as one letter."""
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[a-z]+", "x", re.sub(r"[A-Z]+", "X", re.sub(r"[^\x00-\x7f]+", "x", token))))
    return out[:40]


class Tokens:
    """Hashed features of a token by itself and as a neighbour, with a bounded cache."""

    MOST = 200_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[list[int], int, int]] = {}

    def __call__(self, token: str) -> tuple[list[int], int, int]:
        if (found := self.known.get(token)) is None:
            if len(self.known) > self.MOST:
                self.known.clear()
            found = self.known[token] = self.made(token)
        return found

    def made(self, token: str) -> tuple[list[int], int, int]:
        core, n = token.strip(STRIP), len(digits_of(token))
        word = core.lower() if len(core) <= 12 and not n else ""
        hexed = len(core) >= 16 and n >= 3 and n < len(core) and core.isascii() and core.isalnum()
        form = "long" if hexed else shape(core)
        own = [f"s{form}", f"n{min(n, 20)}", f"w{word}", f"@{'@' in core}", f"+{core[:1] == '+'}", f"h{hexed}", f"q{token[:1] in chr(34) + chr(39)}", f"a{'(at)' in token or '[at]' in token}", f".{core.count('.')}"]
        near = word or form
        return [slot(x) for x in own], slot(f"<{near}"), slot(f">{near}")


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % HASHED


class Graph:
    """Nodes and edges of many documents: tokens of interest with their surroundings."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens = tokens
        self.rows: list[list[int]] = []
        self.places: list[tuple[int, int, int]] = []  # document, start, end
        self.label: list[int] = []  # -1: unknown
        self.edges: dict[str, list[tuple[int, int]]] = {e: [] for e in EDGES}

    def add(self, document: int, text: str, spans: list[Span]) -> None:
        """The nodes of a text; those that overlap a given span have its label, others have none known."""
        addresses = [m.span() for m in SPELLED.finditer(text)] if " at " in text or "at)" in text or "at]" in text else []
        if not addresses and not MARK.search(text):
            return
        found = [m.span() for m in TOKEN.finditer(text)]
        of_interest = np.zeros(len(found), bool)
        starts = np.array([a for a, _ in found])
        of_interest[np.searchsorted(starts, [m.start() for m in MARK.finditer(text)], "right") - 1] = True
        for a, b in addresses:
            of_interest[np.searchsorted(starts, a, "right") - 1 : np.searchsorted(starts, b, "left")] = True
        wide = np.convolve(of_interest, np.ones(2 * REACH + 1), "same") if len(found) > 2 * REACH else np.ones(len(found))
        node: dict[int, int] = {}
        words = [text[a:b] for a, b in found]
        for i in np.flatnonzero(wide > 0.5).tolist():
            node[i] = len(self.rows)
            row = list(self.tokens(words[i])[0])
            row.append(self.tokens(words[i - 1])[1] if i else slot("<start"))
            row.append(self.tokens(words[i + 1])[2] if i + 1 < len(found) else slot(">end"))
            self.rows.append(row)
            self.places.append((document, *found[i]))
            self.label.append(-1)
            if i - 1 in node:
                self.edges["chain"].append((node[i - 1], node[i]))
        for kind, a, b in spans:
            for i in range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))):
                if i in node:
                    self.label[node[i]] = ORDER[kind]
        self.tie(text, words, found, node, starts, addresses)

    def tie(self, text: str, words: list[str], found: list[tuple[int, int]], node: dict[int, int], starts: np.ndarray, addresses: list[tuple[int, int]]) -> None:
        """Features of runs of numbers, and skip edges from each mention to the first of its value."""
        mentions: list[tuple[str, str, int]] = []
        run: list[int] = []
        for i in [*node, -1]:
            number = i >= 0 and bool(digits_of(words[i])) and not any(c.isalpha() for c in words[i])
            if run and not (number and i == run[-1] + 1 and words[run[-1]][-1] not in STRIP):
                value = digits_of(" ".join(words[k] for k in run))
                checked = "" if not 12 <= len(value) <= 19 else "+" if luhn(value) else "-"
                for k in run:
                    self.rows[node[k]] += [slot(f"g{min(len(value), 20)}{checked}"), slot(f"r{len(run)}")]
                if len(value) >= 7:
                    mentions.append(("same", value, run[-1]))
                    mentions.append(("similar", value[-7:], run[-1]))
                run = []
            if number:
                run.append(i)
            elif i >= 0 and ("@" in words[i] or len(words[i]) >= 16):
                mentions.append(("same", words[i].strip(STRIP).lower(), i))
        for a, b in addresses:
            if (i := int(np.searchsorted(starts, b, "left")) - 1) in node:
                mentions.append(("same", plain(text[a:b]), i))
                for k in range(int(np.searchsorted(starts, a, "right")) - 1, i + 1):
                    if k in node:
                        self.rows[node[k]].append(slot("spelled"))
        first: dict[tuple[str, str], int] = {}
        for kind, value, i in mentions:
            head = first.setdefault((kind, value), i)
            if head != i and (node[head], node[i]) not in self.edges["same"][-1:]:  # one edge, the stronger one, ties a pair
                self.edges[kind].append((node[head], node[i]))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Features (padded with HASHED, which weighs nothing), labels and edges."""
        width = max(map(len, self.rows), default=1)
        rows = np.full((len(self.rows), width), HASHED, np.int64)
        for i, row in enumerate(self.rows):
            rows[i, : len(row)] = row
        return rows, np.array(self.label, np.int64), {e: np.array(x, np.int64).reshape(-1, 2) for e, x in self.edges.items()}


class Field:
    """Potentials: of tokens (HASHED + 1 rows), of the chain (left, right) and of both skip edges (symmetric)."""

    def __init__(self) -> None:
        self.unary = np.zeros((HASHED + 1, len(LABELS)))
        self.pair = {e: np.zeros((len(LABELS), len(LABELS))) for e in EDGES}
        self.trained = False

    def train(self, texts: list[str], steps: int = 80, rate: float = 0.4, ridge: float = 2e-6) -> None:
        """Pseudo-likelihood by adaptive gradient steps; nothing is learnt without a base span."""
        graph, document = Graph(Tokens()), 0
        for text in texts:
            for form, spans in ((text, base_spans(text)), masked(text)):
                marked = spans + [("secret", *m.span(1)) for m in SECRET.finditer(form)]
                first = len(graph.rows)
                graph.add(document, form, marked)
                settle(graph, form, first)
                document += 1
        rows, labels, edges = graph.arrays()
        if not (labels > 0).any():
            return
        n, k = len(LABELS), len(rows)
        one = np.zeros((k, n))
        one[labels >= 0, labels[labels >= 0]] = 1  # unknown neighbours say nothing
        known = labels >= 0
        square = {e: np.full((n, n), 1e-3) for e in EDGES} | {"unary": np.full(self.unary.shape, 1e-3)}
        flat = rows.ravel()
        for _ in range(steps):
            z = self.unary[rows].sum(axis=1)
            for e, (a, b) in ((e, x.T) for e, x in edges.items()):
                np.add.at(z, b, one[a] @ self.pair[e])
                np.add.at(z, a, one[b] @ self.pair[e].T)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            gap = (p / p.sum(axis=1, keepdims=True) - one) * known[:, None] / known.sum()
            total = np.zeros_like(self.unary)
            for label in range(n):
                total[:, label] = np.bincount(flat, np.repeat(gap[:, label], rows.shape[1]), HASHED + 1)
            total += ridge * self.unary
            total[HASHED] = 0
            square["unary"] += total**2 * 1e6
            self.unary -= rate * total * 1e3 / np.sqrt(square["unary"])
            for e, (a, b) in ((e, x.T) for e, x in edges.items()):
                g = one[a].T @ gap[b] + gap[a].T @ one[b] + 50 * ridge * self.pair[e]
                g = g if e == "chain" else (g + g.T) / 2
                square[e] += g**2 * 1e6
                self.pair[e] -= rate * g * 1e3 / np.sqrt(square[e])
        self.trained = True

    def marginals(self, graph: Graph, clamped: bool = True) -> np.ndarray:
        """Label marginals of each node, given the known labels if ``clamped``."""
        rows, labels, edges = graph.arrays()
        unary = self.unary[rows].sum(axis=1)
        if clamped:
            fixed = labels >= 0
            unary[fixed] = -60.0
            unary[fixed, labels[fixed]] = 0.0
        return sum_product(unary, [(x, self.pair[e]) for e, x in edges.items()])


def sum_product(unary: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product over groups of edges (pairs of nodes, matrix of log-potentials); exact without cycles."""
    source = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in groups])
    target = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in groups])
    matrices, reverse, at = [], [], 0
    for e, m in groups:
        matrices += [(slice(at, at + len(e)), np.exp(m)), (slice(at + len(e), at + 2 * len(e)), np.exp(m.T))]
        reverse += [np.arange(at + len(e), at + 2 * len(e)), np.arange(at, at + len(e))]
        at += 2 * len(e)
    back, message = np.concatenate(reverse), np.zeros((at, unary.shape[1]))
    belief = unary
    for turn in range(max(ROUNDS, 1)):
        out = belief[source] - message[back]
        p = np.exp(out - out.max(axis=1, keepdims=True, initial=-1e300))
        fresh = np.empty_like(message)
        for part, m in matrices:
            fresh[part] = np.log(p[part] @ m)
        fresh -= fresh.max(axis=1, keepdims=True, initial=-1e300)
        if turn >= 20:  # damped where cycles keep messages moving
            fresh = (fresh + message) / 2
        moved, message = np.abs(fresh - message).max(initial=0), fresh
        belief = unary.copy()
        for label in range(unary.shape[1]):
            belief[:, label] += np.bincount(target, message[:, label], len(unary))
        if moved < SETTLED:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True, initial=-1e300))
    return p / p.sum(axis=1, keepdims=True)


def settle(graph: Graph, text: str, first: int) -> None:
    """Label none for the unlabelled nodes of a text from ``first`` on, but for candidates, which stay unknown."""
    unsure = [m.span() for m in SPELLED.finditer(text)]
    for m in re.finditer(r"[0-9](?:[ ().-]{0,2}[0-9]){8,}", text):
        value = digits_of(m[0])
        if len(value) <= 15 or (len(value) <= 19 and luhn(value)):
            if not (12 <= len(value) and not luhn(value)):
                unsure.append(m.span())
    unsure.sort()
    ends, k = [b for _, b in unsure], 0
    for i in range(first, len(graph.rows)):
        _, a, b = graph.places[i]
        while k < len(unsure) and ends[k] <= a:
            k += 1
        if graph.label[i] < 0 and not (k < len(unsure) and unsure[k][0] < b):
            graph.label[i] = 0


def rewritten(kind: str, value: str) -> str:
    """A base mention as it is written where no pattern should see it."""
    if kind == "email":
        local, _, host = value.partition("@")
        return f"{local} at {host.replace('.', ' dot ')}"
    if kind == "ip":
        return value.replace(".", "[.]")
    if kind == "card":
        digits = digits_of(value)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    bare = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", value) if len(digits_of(value)) > 9 else value[1:]
    sign = ("", "-", ".", " ")[zlib.crc32(value.encode()) // 2 % 4]
    return sign.join(re.findall(r"[0-9]+", bare)) if sign else bare


def masked(text: str) -> tuple[str, list[Span]]:
    """The text with about half of its base spans rewritten, and all spans where they are then."""
    out, spans, at = [], [], 0
    size = 0
    for kind, a, b in base_spans(text):
        if a < at:
            continue
        value = text[a:b]
        if zlib.crc32(f"{a}{value}".encode()) % 2:
            value = rewritten(kind, value)
        out += [text[at:a], value]
        size += a - at
        spans.append((kind, size, size + len(value)))
        size += len(value)
        at = b
    return "".join([*out, text[at:]]), spans


def plausible(kind: str, value: str) -> bool:
    """Whether a mention can be of its kind at all."""
    n = len(digits_of(value))
    if kind == "email":
        return bool(SPELLED.fullmatch(value)) or "@" in value
    if kind == "ip":
        return bool(DOTTED.fullmatch(value)) and all(int(x) <= 255 for x in re.findall(r"[0-9]+", value))
    if kind == "card":
        return 12 <= n <= 19 and luhn(digits_of(value))
    if kind == "phone":
        return 7 <= n <= 15 and not any(c.isalpha() for c in value)
    return len(value) >= 16 and n > 0 and any(c.isalpha() for c in value)


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The mention without the signs around it."""
    strip = STRIP if kind == "phone" else STRIP + "()"
    while a < b and text[a] in strip:
        a += 1
    while b > a and text[b - 1] in strip:
        b -= 1
    if kind == "secret":  # the value of an assignment in one token
        for sign in "=:":
            if (k := text.rfind(sign, a, b)) >= 0:
                a = k + 1
        return (a, b) if text[a:b] == text[a:b].strip(strip) else trimmed(kind, text, a, b)
    return a, b


def chunks(texts: list[str]) -> Iterator[slice]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    yield slice(first, len(texts))


def added_spans(texts: list[str], bases: list[list[Span]], field: Field, tokens: Tokens) -> list[list[Span]]:
    """For each text the spans that the field adds to its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    if not field.trained:
        return out
    graph = Graph(tokens)
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        graph.add(i, text, base)
    if not graph.rows:
        return out
    p = field.marginals(graph)
    best, sure, known = p.argmax(axis=1), p.max(axis=1), np.array(graph.label) >= 0
    chained = np.zeros(len(p), bool)
    chained[[b for _, b in graph.edges["chain"]]] = True
    good = (best > 0) & ~known
    for run in np.split(np.arange(len(p)), np.flatnonzero(~(chained[1:] & good[1:] & good[:-1] & (best[1:] == best[:-1]))) + 1):
        if not good[run[0]]:
            continue
        document, kind = graph.places[run[0]][0], LABELS[best[run[0]]]
        for part in ([run], [[i] for i in run]):  # the whole run, or else its tokens
            spans = []
            for nodes in part:
                a, b = trimmed(kind, texts[document], graph.places[nodes[0]][1], graph.places[nodes[-1]][2])
                if sure[nodes].mean() >= CERTAIN and plausible(kind, texts[document][a:b]):
                    spans.append((kind, a, b))
            if spans:
                break
        taken = bases[document]
        out[document] += [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in taken)]
    return out


def measure(texts: list[str], field: Field) -> dict[str, int]:
    """Counts on masked texts: rewritten mentions that are found (hits) and missed, and added spans that are none of them (wrong)."""
    forms = [masked(t) for t in texts]
    bases = [base_spans(t) for t, _ in forms]
    counts = {"hits": 0, "missed": 0, "wrong": 0}
    for (_, spans), base, more in zip(forms, bases, added_spans([t for t, _ in forms], bases, field, Tokens()), strict=True):
        hidden = [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in base)]
        found = {(k, a) for k, a, _ in more if k != "secret"}
        hits = sum(any(k == s[0] and s[1] - 1 <= a <= s[1] + 1 for k, a in found) for s in hidden)
        counts = {"hits": counts["hits"] + hits, "missed": counts["missed"] + len(hidden) - hits, "wrong": counts["wrong"] + len(found) - hits}
    return counts


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def sample(docs: DataFrame, id_col: str, text_col: str, most: int = SAMPLE_DOCS) -> list[str]:
    """At most ``most`` texts with digits or an @, those first in a hash order of the ids."""
    text = F.col(name(text_col))
    seen = docs.filter(text.rlike(r"[0-9]{2}|@") & (F.length(text) <= SAMPLE_CHARS))
    hashed = F.xxhash64(F.col(name(id_col)).cast("string"))
    # the hashes alone are ordered; texts move only for those under the limit found
    last = seen.select(hashed.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    found = seen.select(text.alias("text"), hashed.alias("h")).filter(F.col("h") <= last).orderBy("h", "text").limit(most)
    return [r["text"] for r in found.toLocalIterator()]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts of base spans, their digest, all spans (start and end in code points), and counts of added ones."""
    field = Field()
    field.train(sample(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            bases = [base_spans(t) for t in texts]
            rows = []
            added = [more for part in chunks(texts) for more in added_spans(texts[part], bases[part], shared.value, tokens)]
            for base, more in zip(bases, added, strict=True):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                secrets = sum(s[0] == "secret" for s in more)
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), secrets, int(bool(base or more))))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "flagged"])
            out.insert(0, "id", batch["id"].values)
            yield out

    schema = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_secret bigint, flagged int"
    rows = docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.col(name(text_col)).alias("text"))
    return map_with_id(rows, run, schema).withColumnRenamed("id", id_col)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
