"""Each operator against brute force on a small table with nulls, ties, repeats, empty and long texts and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodequery.llm import bpe, components, exact_dedup, fingerprints, fm_index, mixing, pii, queries, shards, simhash, substring_dedup, toxicity, url_filter
from lodequery.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
bag = lambda df, *cols: Counter(map(tuple, df.select(*cols).collect()))


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[sha((r[1] or "").translate(LOWER))].append(r[0])
    want = Counter((r[0], max((i for i in groups[k] if i is not None), default=None), len(groups[k]), k) for r in rows for k in [sha((r[1] or "").translate(LOWER))])
    got = exact_dedup.exact_dedup(docs).cache()
    assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert bag(got.filter("kept"), "text_sha256") == Counter((k,) for k in groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(300)]
    made, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        body = [rng.choice(filler) for _ in range(30)] + ([f"nasty{rng.choice('xyz')}"] * 2 if toxic else [])
        rng.shuffle(body)
        made.append((i, " ".join(body), "en"))
        labels.append((i, 1, int(toxic)))
    data, marks = spark.createDataFrame(made, "doc_id bigint, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    network = toxicity.fit(data, marks)
    got = {r.doc_id: r for r in toxicity.judge(data, network).collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    clean = toxicity.drop_toxic(data, marks)
    assert clean.columns == data.columns and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].flagged}
    assert network.by_lang and np.mean([got[i].flagged == labels[i][2] for i in held]) > 0.97
    assert toxicity.judge(docs, network).count() == len(rows)
    assert toxicity.judge(empty, network).count() == 0
    assert {r.score for r in toxicity.judge(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0.0}


def test_labels_keep_their_share_if_ids_repeat(spark):
    texts = [(1, f"calm {i}") for i in range(600)] + [(2, f"nasty {i}") for i in range(600)] + [(3, "x" * 30_000)]
    data, marks = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id bigint, toxic int")
    open_ = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = Counter(toxicity.sample(data, marks, "doc_id", "text", 50).toPandas()["toxic"])
    assert got == Counter({label: 100 for i, label in ((1, 0), (2, 1)) if i in open_})


def test_toxicity_learns_from_every_row_whole(spark):
    """Each open label row counts, with the end of a long text: the last words of 20,000 characters tell the label here."""
    made = [(i, ("calm sea " * 2_300 if i % 3 else "still air ") + ("nasty" if i % 2 else "kind")) for i in range(150)]
    data = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(i, i % 2) for i, _ in made] + [(5, 0), (5, 1), (None, 1)], "doc_id bigint, toxic int")
    network = toxicity.fit(data, marks)
    got = {r.doc_id: r.predicted for r in toxicity.judge(data, network).collect()}
    assert got == {i: i % 2 for i in got}
    rows = toxicity.labelled(data, marks, "doc_id", "text")
    want = defaultdict(lambda: [0, 0])
    for i, text in made:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            own = [i % 2] + [0, 1] * (i == 5)
            for b in {b for w in text.split() for b in toxicity.buckets_of(w)}:
                want[b][0] += len(own)
                want[b][1] += sum(own)
    assert {r.bucket: [r.met, r.bad] for r in toxicity.evidence(rows).collect()} == want


def test_toxicity_sends_the_driver_small_pieces(spark, monkeypatch):
    """A network of 4 MB as one value, and one kept for each pass, made the driver's heap grow."""
    made = [(i, ("still air " if i % 3 else "calm sea ") + ("nasty" if i % 2 else "kind")) for i in range(300)]
    data, marks = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i, _ in made], "doc_id bigint, toxic int")
    frame, context, sizes, sent = type(data), type(spark.sparkContext), [], []
    collect, broadcast = frame.collect, context.broadcast

    def collected(self):
        rows = collect(self)
        sizes.extend(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray))
        return rows

    monkeypatch.setattr(frame, "collect", collected)
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    assert toxicity.fit(data, marks).trained
    assert sizes and max(sizes) < 1 << 17
    assert len(sent) <= toxicity.PASSES + 1 and not any(os.path.exists(b._path) for b in sent)


def test_lines_against_every_cut():
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 400):
        z = -np.sort(-rng.choice(4000, n, replace=False)) / toxicity.STEPS
        bad, clean = rng.integers(0, 3, n), rng.integers(0, 4, n)
        cuts = [2 * bad[: k + 1].sum() / max(1, (bad + clean)[: k + 1].sum() + bad.sum()) for k in range(n)]
        line = toxicity.best_line(z, bad, clean)
        if bad.sum():
            assert 2 * bad[z >= line].sum() / ((bad + clean)[z >= line].sum() + bad.sum()) == pytest.approx(max(cuts))
        line = toxicity.guarded_line(z, bad, clean)
        assert clean[z >= line].sum() <= toxicity.MOST_CLEAN * clean.sum()


def test_pooling_against_plain_windows():
    network, rng = toxicity.Network(2), random.Random(4)
    network.shift += 0.01
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (1, 2, 3, 50, 7, 0, 120)] + [None]
    want = []
    for text in texts:
        own = [network.embed[list(toxicity.buckets_of(w))].sum(axis=0) for w in (text or "").split()]
        tops = []
        for _, width, first in network.slices():
            for f in range(toxicity.FILTERS):
                sums = [sum(own[i + k] @ network.filters[:, first[k] + f] for k in range(width)) for i in range(len(own) - width + 1)]
                tops.append(max(0.0, max(sums, default=-1.0) + network.shift[len(tops)]) if sums else 0.0)
        want.append(np.dot(tops, network.out) + network.bias)
    for piece, most in ((1 << 16, 1 << 17), (16, 20), (5, 1)):
        assert network.reader().outputs(texts, piece, most) == pytest.approx(np.array(want), abs=1e-5)


def test_gradients_against_differences():
    network, rng = toxicity.Network(3), np.random.default_rng(5)
    for part in ("embed", "filters", "shift", "out"):
        setattr(network, part, getattr(network, part).astype(np.float64))
    network.embed = rng.normal(0, 0.5, (40, toxicity.DIM))
    table_of = rng.integers(0, 40, (12, 3))
    docs, labels, weight = [rng.integers(0, 12, n) for n in (1, 5, 9)], np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        z = np.array([network.pooled(network.embed[table_of[d]].sum(axis=1) @ network.filters)[0] @ network.out + network.bias for d in docs])
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum())

    own = network.gradients(docs, labels, weight, table_of)
    dense = np.zeros_like(network.embed)
    dense[own["rows"]] = own["embed"]
    for part, gradient in (("embed", dense), ("filters", own["filters"]), ("shift", own["shift"]), ("out", own["out"])):
        values = getattr(network, part)
        for place in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(25)]:
            before = values[place]
            values[place] = before + 1e-4
            up = loss()
            values[place] = before - 1e-4
            assert gradient[place] == pytest.approx((up - loss()) / 2e-4, abs=2e-3)
            values[place] = before


def brute_simhash(text):
    own = words((text or "").translate(LOWER))
    pieces = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_few_links_are_not_shuffled_and_many_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    few = connected_components(links)
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(components, "SMALL_LINKS", 10)
    assert bag(few, "node", "root") == bag(connected_components(links), "node", "root")


def closure(prints, distance=2):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[a] != label[b] and (a ^ b).bit_count() <= distance:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(docs, rows, empty):
    prints = [brute_simhash(r[1]) for r in rows]
    label = closure(set(prints))
    least = {c: min((r[0] for r, p in zip(rows, prints) if label[p] == c and r[0] is not None), default=None) for c in set(label.values())}
    got = simhash.near_groups(docs)
    assert bag(got, "doc_id", "fingerprint", "component_id") == Counter((r[0], f"{p:016x}", least[label[p]]) for r, p in zip(rows, prints))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for c in least.values()})
    assert simhash.near_groups(empty).count() == 0


def test_one_row_of_each_near_component(spark):
    rng = random.Random(8)
    make = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))
    texts = [make() for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (7, texts[6]), (7, texts[7]), (7, texts[7]), (3, texts[7]), (None, texts[8]), (9, texts[8])]
    prints = [brute_simhash(t) for _, t in rows]
    label = closure(set(prints))
    least = {}
    for (i, t), p in zip(rows, prints):
        least.setdefault(label[p], []).append((i is None, i or 0, t))
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(label[brute_simhash(r.text)] for r in kept) == Counter(set(label.values()))
    assert all((r.doc_id is None, r.doc_id or 0) == min(least[label[brute_simhash(r.text)]])[:2] for r in kept)


def test_grid_links_find_every_pair(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints):
        for _ in range(4):
            for k in (1, 2, 3):
                q = p
                for b in rng.sample(range(64), k):
                    q ^= 1 << b
                prints.add(q)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    roots = {r.node: r.root for r in connected_components(simhash.links(table)).collect()}
    want, label = defaultdict(set), closure(prints)
    for s, p in signed.items():
        want[label[p]].add(s)
    got = defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in connected_components(links).collect()} == {0}
    assert connected_components(links.limit(0)).count() == 0


def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(docs, rows, empty):
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("a1@.+-( )95 ") for _ in range(120))
        assert pii.base_spans(text) == brute_spans(text)
    got = pii.find(docs).collect()
    want = Counter((r[0], sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r[1] or "")))) for r in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len([s for s in r.spans.split(",") if s]) - r.n_added
    assert pii.find(empty).count() == 0


PERSONAL = ["call +1 (583) 555-{0:04d} now", "mail bo.{0}@mail.example.com or not", "card 4111 1111 1111 1111 is", "host 10.2.{0}.9 there", "at 99{0:06d} there", 'token = "a{0:04d}24be64439e3e49cf46b2d7c90f3602a3d0b"']


@pytest.fixture(scope="module")
def field():
    model = pii.Field()
    model.train([PERSONAL[i % len(PERSONAL)].format(i % 250) + f" word{i % 17} and others" for i in range(600)])
    return model


def test_masked_mentions_are_found(field):
    held = [PERSONAL[i % len(PERSONAL)].format(i % 250) + f" word{i % 13} more" for i in range(600, 1000)]
    counts = pii.measure(held, field)
    assert counts["hits"] > 0.9 * (counts["hits"] + counts["missed"]) > 50 and counts["wrong"] <= 0.05 * counts["hits"]


def test_field_adds_what_patterns_miss(field):
    added = lambda text: [(k, text[a:b]) for k, a, b in pii.added_spans([text], [pii.base_spans(text)], field, pii.Tokens())[0]]
    assert added("mail jo.smith at example dot com or jo.smith@example.com") == [("email", "jo.smith at example dot com")]
    assert added("+1 583 555 8469 was called; then (583) 555-8469, again") == [("phone", "(583) 555-8469")]
    assert added('its token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ends') == [("secret", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2")]
    assert added("nothing 55443322 here, 4316522678525457 neither, in 2024-05-12") == [] and added("") == []
    assert pii.added_spans(["(583) 555-8469"], [[]], pii.Field(), pii.Tokens()) == [[]]


def test_tied_mentions_share_their_label(field):
    odd, unsure = "ref 583/5558469 x", pii.Graph(pii.Tokens())
    unsure.add(0, odd, [])
    tied, text = pii.Graph(pii.Tokens()), "+1 583 555 8469 " + "word " * 300 + odd + " word" * 200 + " +1 583 555 8469"
    tied.add(0, text, pii.base_spans(text))
    alone, together = field.marginals(unsure), field.marginals(tied)
    place = next(i for i, (_, a, b) in enumerate(tied.places) if text[a:b] == "583/5558469")
    own = next(i for i, (_, a, b) in enumerate(unsure.places) if odd[a:b] == "583/5558469")
    assert together[place, pii.ORDER["phone"]] > alone[own, pii.ORDER["phone"]]
    assert any(place in edge for edge in tied.edges["similar"])


@pytest.mark.parametrize("cycle", [False, True])
def test_messages_against_enumeration(cycle):
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(20):
        n, k, scale = 5, 3, 0.4 if cycle else 2.0
        unary = rng.normal(0, 1, (n, k))
        chain = np.array([(i, i + 1) for i in range(n - 1)] + ([(0, 4)] if cycle else []))
        pair, skip = rng.normal(0, scale, (k, k)), rng.normal(0, scale, (k, k))
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            mass = math.exp(sum(unary[i, y[i]] for i in range(n)) + sum((pair if j < 3 else skip)[y[a], y[b]] for j, (a, b) in enumerate(chain)))
            for i in range(n):
                want[i, y[i]] += mass
        want /= want.sum(axis=1, keepdims=True)
        got = pii.sum_product(unary, [(chain[:3], pair), (chain[3:], skip)])
        assert np.allclose(got, want, atol=0.03 if cycle else 1e-6)


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    by_id = {i: c for i, c in Counter(r[0] for r in rows).items()}
    for r, after in zip(order, [*order[1:], order[0]]):
        if r[0] is not None and by_id[r[0]] == 1 and by_id[after[0]] == 1:
            mine, text, other = next(g for g in got if g.doc_id == r[0]), r[1] or "", after[1] or ""
            edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            assert mine.n_chars == len(text) and mine.edited_sha256 == sha(edited)
            assert mine.fingerprint == fingerprints.sketch(fingerprints.shingle_hashes(text)) and mine.edited_fingerprint == fingerprints.sketch(fingerprints.shingle_hashes(edited))
            own, its, new = (set(fingerprints.shingle_hashes(x).tolist()) for x in (text, other, edited))
            for value, b in ((mine.near_next, its), (mine.near_edited, new)):
                true = len(own & b) / len(own | b) if own | b else 1.0
                assert abs(value - true) < 0.2
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(docs.filter("doc_id = 12")).first().near_next == 1.0


def test_likeness_is_unbiased():
    rng, gaps = np.random.default_rng(0), []
    for size in (3, 40, 400, 4000):
        for share in (0.0, 0.5, 0.9):
            base = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            a, b = base[:size], np.concatenate([base[: int(size * share)], base[size : 2 * size - int(size * share)]])
            true = len(set(a) & set(b)) / len(set(a) | set(b))
            gaps.append(fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) - true)
    assert max(map(abs, gaps)) < 0.25 and abs(np.mean(gaps)) < 0.05


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode_decode(docs).cache()
    assert bag(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256 for r in got.collect())
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_on_random_words():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(bpe.default_path()), bpe.Speculator(bpe.default_path()), random.Random(4)
    texts = ["".join(rng.choice("abcdeaeiothn' é1!?東İΣ") for _ in range(60)) for _ in range(400)]
    for text, (ids, tokens) in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and tokens == library.decode(want, skip_special_tokens=False)


def test_shards(docs, rows, empty):
    got = shards.place(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.place(empty).count() == 0


def test_shard_weights(spark):
    ids = spark.range(4000).withColumn("key", F.col("id").cast("string"))
    tree = shards.regions(16)
    counts = Counter(r.s for r in shards.descend(ids, "key", shards.grown(tree, 16), "s").collect())
    assert set(counts) == set(range(17)) and max(counts.values()) < 2 * min(counts.values())


def test_url_filter(spark, empty):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/1", "http://a.example.com/en/2?x", "http://example.com", "https://x.net/es/3", "https://x.net/de/3#t", "http://notexample.com/en/", "http://b.org?u=http://c.com/", "http://EXAMPLE.com/en"]
    urls += [f"http://h{i % 3}.net/{('es', 'fr', 'de')[i % 3]}/{i}" for i in range(60)] + [f"http://o.org/{('es', 'xx')[i % 2]}/{i}.html" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "x", "t") for i, u in enumerate([*urls, urls[3]])] + [(None, None, None, None)], "page_id bigint, url string, host string, template string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 2
    every = {r.page_id: r for r in got}
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(LOWER)
        best = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        assert (every[i].host, every[i].path, every[i].rule) == (host, path, best and best[1] + best[2])
        assert best is None or every[i].verdict == best[0]
    assert {every[i].template for i in range(11, 71) if urls[i].split("/")[3] == "es"} == {"/es/*"}
    assert {every[i].verdict for i in range(71, 111) if "/es/" in urls[i]} == {"block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_frequent_and_deep_segments(spark):
    paths = [("h.com", f"/es/{i % 2}") for i in range(40)] + [("h.com", f"/slug{i}") for i in range(60)]
    paths += [(f"s{i}.com", ("/es", f"/only{i}")[i % 2]) for i in range(40)]  # hosts of one row follow the place over all hosts
    paths += [("big.com", f"/slug{i % 3}") for i in range(40)]  # rows enough to decide that it is not variable
    paths += [("deep.com", f"/a/b/c/d/e/{i}/end") for i in range(20)] + [("lone.com", "/x/y//z/1/2/3/4/"), ("lone.com", ""), ("lone.com", "/")]
    rows = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(paths)], "id bigint, host string, path string")
    out = url_filter.templates(rows).collect()
    got = {(r.host, r.path): (r.parent, r.template) for r in out}
    assert len(out) == len(paths) and set(got) == set(paths)
    for (host, path), (parent, template) in got.items():
        want = path
        if host == "h.com" and "slug" in path or "only" in path:
            want = "/*"
        if host == "lone.com" and path:  # a rare value of a small host
            want = "/*" + path[2:]
        if host == "deep.com":
            want = "/a/b/c/d/e/*/end"
        assert (template, parent) == (want, want.rpartition("/")[0]), (host, path)


def test_purity_by_hand(spark):
    rows = [("h", "", "/a", 1)] * 30 + [("h", "", "/a", 0)] * 2 + [("h", "", "/b", 1)] * 10 + [("h", "", "/c", 0)] * 40 + [("g", "", "/d", None)]
    got = {(r.host, r.template): r for r in url_filter.judged(spark.createDataFrame(rows, "host string, parent string, template string, label int")).collect()}
    rate = 40 / 82
    across = lambda bad, n: (bad + 5 * rate) / (n + 5)
    assert got["h", "/a"].purity == pytest.approx((40 + 5 * across(30, 32)) / 47)  # /a and /b are merged
    assert got["h", "/c"].purity == pytest.approx((0 + 5 * across(0, 40)) / 45)
    assert got["g", "/d"].purity == pytest.approx(rate)


def brute_repeats(rows, window=50):
    first = {}
    for r in rows:
        own = words(r[1])
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, math.inf), math.inf if r[0] is None else r[0])
    out = Counter()
    for r in rows:
        own = words(r[1])
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < (math.inf if r[0] is None else r[0]):
                gone.update(range(i, i + window))
        out[r[0], len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone))] += 1
    return out


@pytest.mark.parametrize("heavy", [1000, 1])
def test_substrings(docs, rows, empty, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)  # 1: nearly all names take the way by window digests
    got = substring_dedup.drop_repeats(docs)
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    if heavy == 1000:
        assert substring_dedup.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("heavy", [1000, 1])
def test_substrings_repeated_in_one_document(spark, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    menu = " ".join(f"m{i}" for i in range(58))
    own = [(1, "a " * 60), (2, "a " * 200), (3, f"{menu} tail"), (4, f"x {menu} y {menu} z {menu}"), (4, f"q {menu} y {menu}"), (5, "a " * 300), (None, "b " * 70), (6, "b " * 55), (2**63 - 1, "c " * 60 + "b " * 60), (None, "c " * 60), (None, "d " * 60), (None, "d " * 61)]
    got = substring_dedup.drop_repeats(spark.createDataFrame(own, "doc_id bigint, text string"))
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(own)
    assert {r.n_removed for r in got.filter("doc_id = 2").collect()} == {200}


def test_fm_index_against_search():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64) for _ in range(30)]
    owners = rng.permutation(30)
    counts = np.array([len(p) - 4 for p in parts])
    got = set(zip(*(x.tolist() for x in fm_index.FMIndex(parts, owners).covered(owners, counts, 5))))
    where = defaultdict(set)
    for s, p in enumerate(parts):
        for i in range(len(p) - 4):
            where[tuple(p[i : i + 5])].add(owners[s])
    assert got == {(s, i) for s, p in enumerate(parts) for i in range(len(p) - 4) if min(where[tuple(p[i : i + 5])]) < owners[s]}


def test_fm_index_of_one_word():
    for n in range(5, 80):
        parts = [np.full(n, 7, np.uint64), np.full(5, 7, np.uint64)]
        segment, _ = fm_index.FMIndex(parts, np.array([1, 0])).covered(np.array([1, 0]), np.array([n - 4, 1]), 5)
        assert segment.tolist() == [0] * (n - 4)


def test_mixing(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    got = mixing.mix(docs, shards=4).cache()
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}
    left, budget = set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        budget, left = budget - sum(2 * sizes[s] for s in over), left - over
    sums = defaultdict(int)
    for r in got.select("source", "size", "target", "source_size", taken.alias("taken")).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        sums[r.source] += r.taken
    assert all(sums[s] == round(target[s]) for s in sizes)
    again = mixing.mix(docs.repartition(7), shards=4)
    assert Counter(map(str, got.select("id", "size", "draws").collect())) == Counter(map(str, again.select("id", "size", "draws").collect()))
    mixed = mixing.mixed_rows(docs, shards=4)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(sums.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_split_quotas_are_exact():
    import pandas as pd

    drawn = pd.DataFrame({"source_key": list("abc"), "drawn": [700, 20, 0]})
    quotas = mixing.split_quotas(drawn, 7)
    assert quotas.sum(axis=1).tolist() == [700, 20, 0] and quotas.sum(axis=0).max() - quotas.sum(axis=0).min() <= 7
    assert (quotas == mixing.split_quotas(drawn, 7)).all() and quotas[0].min() > 60


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
