"""Clashing, dotted and map columns, long words, all code points, hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodequery.llm import bpe, common, exact_dedup, mixing, simhash


@pytest.fixture(scope="module")
def odd(spark):
    """Columns named as the operators' own, one with a dot, one with a map; rows that repeat id and text."""
    rows = [(i % 9, f"text number {i % 7} of some words", f"{i}", "r", {"k": i}, "d", "s", 1) for i in range(40)] + [(None, None, "z", None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, "doc_id bigint, text string, _repeat string, row string, `m` map<string,int>, `a.b` string, source string, key int")


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, simhash.drop_near_copies, mixing.mixed_rows])
def test_rows_are_carried_whole(odd, operator):
    got = operator(odd)
    assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes)
    plain = lambda r: str(tuple(r)[0:1] + tuple(r)[2:])
    given = Counter(plain(r) for r in odd.collect())
    out = got.collect()
    assert out and all(plain(r) in given for r in out)
    if operator is exact_dedup.drop_copies:
        texts = {}
        for r in odd.collect():
            texts.setdefault(r.text or "", []).append(r)
        assert len(out) == len(texts)
        for r in out:
            best = max(-1 if x.doc_id is None else x.doc_id for x in texts[r.text or ""])
            assert (-1 if r.doc_id is None else r.doc_id) == best


def test_many_runs_and_few(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {rng.randrange(60)}") for i in range(500)] + [(1000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    want = Counter((i, max(groups[t.lower()]), len(groups[t.lower()]), i == max(groups[t.lower()])) for i, t in rows)
    for runs in (1, 9, 100):
        got = exact_dedup.exact_dedup(docs, least_runs=runs).select("doc_id", "keep_id", "group_size", "kept")
        assert Counter(map(tuple, got.collect())) == want


def test_texts_of_one_digest_fail(spark):
    entries = spark.createDataFrame([(0, bytearray(b"x"), 1, 1, 5, 7), (1, bytearray(b"x"), 2, 1, 6, 7)], "run int, digest binary, keep_id bigint, group_size bigint, size bigint, check bigint")
    with pytest.raises(Exception, match="two texts of one SHA-256"):
        exact_dedup.merge_round(entries, 0, 8).collect()


@pytest.mark.parametrize("pattern", ["a{0}b", "{0}{0} ", "é{0}'{0}1"])
def test_every_code_point_as_the_library(pattern):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.Speculator(bpe.default_path())
    texts = [pattern.format(chr(c)) for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))]
    for text, want, (ids, _) in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode_batch(texts), strict=True):
        assert ids == " ".join(map(str, want.ids)), hex(ord(max(text)))


def test_a_long_word():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(bpe.default_path()), bpe.Speculator(bpe.default_path()), random.Random(7)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "a", "中日é"):
        text = "".join(rng.choice(letters) for _ in range(200_000))
        assert next(own.encode_batch([text]))[0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
    for n in (2, 30, 60):  # both ways of merging
        parts = [own.vocab[c] for c in (rng.choice("etaoin") for _ in range(n))]
        assert own.merge_long(parts) == bpe.Speculator.merge(own, parts) or n > bpe.LONG


def test_hot_keys_are_joined_by_broadcast(spark):
    big = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 300)] + [(None, 0)], "k int, v int")
    side = spark.createDataFrame([(i, f"s{i}") for i in range(0, 300, 1)], "k int, s string")
    assert [r.k for r in common.hot_keys(big, ["k"]).collect()] == [1]
    for how in ("inner", "left", "left_semi"):
        want = Counter(map(tuple, big.join(side, "k", how).collect()))
        assert Counter(map(tuple, common.join_unique(big, side, ["k"], how).collect())) == want
    assert common.hot_keys(big.filter("k > 1"), ["k"]) is None and common.hot_keys(big.limit(0), ["k"]) is None


def test_components_with_a_hub(spark):
    from lodequery.llm.components import connected_components

    links = spark.range(1, 400).selectExpr("id as a", "0L as b").unionByName(spark.range(400, 420).selectExpr("id as a", "id + 1 as b"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 400 for i in range(400, 421)}


def test_hypergeometric_inversion():
    import math

    for k, rest, want in ((3, 5, 4), (10, 2, 6), (0, 5, 3), (7, 0, 4), (40, 60, 50)):
        whole, upto = math.comb(k + rest, want), 0.0
        for x in range(max(0, want - rest), min(k, want) + 1):
            mass = math.comb(k, x) * math.comb(rest, want - x) / whole
            if mass > 1e-9:
                assert mixing.go_left(k, rest, want, upto + mass / 2) == x
            upto += mass
    big = [mixing.go_left(10**8, 3 * 10**8, 2 * 10**8, (i + 0.5) / 200) for i in range(200)]
    assert big == sorted(big) and abs(sum(big) / 200 - 5 * 10**7) < 300


def test_shards_get_the_quotas_of_the_tree(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "STRATUM_BLOCKS", 5)  # several strata
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 9)), "abcd"[min(3, i % 7)]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=6).collect()
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=1).collect()
    assert {r.id: sum(d.words for d in r.draws) for r in got} == {r.id: sum(d.words for d in r.draws) for r in plan}
    blocks = {}
    for r in got:  # a block's draws are those of its rows; blocks are told apart by the hash of id and text
        text = rows[r.id][1]
        import hashlib

        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        n = sum(x[2] == r.source for x in rows)
        block = int(md5(f"mix-1|block|{r.id}|{md5(text)}")[:13], 16) % -(-n // 4)
        for d in r.draws:
            blocks[r.source, block, d.epoch] = d.shard
    counts = Counter((s, shard) for (s, _, _), shard in blocks.items())
    keys = sorted({s for s, _, _ in blocks})
    have = pd.DataFrame({"source_key": [f"s{s}" for s in keys], "drawn": [sum(n for (t, _), n in counts.items() if t == s) for s in keys]})
    quotas = mixing.split_quotas(have, 6)
    assert {(s, j): int(quotas[i, j]) for i, s in enumerate(keys) for j in range(6) if quotas[i, j]} == dict(counts)
    totals = quotas.sum(axis=0)
    assert totals.max() - totals.min() <= 3


def test_large_ids_beside_null_ids(spark):
    from lodequery.llm import fingerprints, pii, substring_dedup, toxicity

    docs = spark.createDataFrame([(2**63 - 1, "one two"), (None, "three"), (2**53 + 1, "x"), (-(2**63), "y")], "doc_id bigint, text string").coalesce(1)
    want = {2**63 - 1, None, 2**53 + 1, -(2**63)}
    for got in (bpe.encode_decode(docs), fingerprints.fingerprint_edits(docs), pii.find(docs), simhash.near_groups(docs), substring_dedup.drop_repeats(docs), toxicity.judge(docs, toxicity.Network())):
        assert {r.doc_id for r in got.collect()} == want


def brute_verdicts(urls):
    """The template tree in plain Python: verdict of each url."""
    import math
    import re

    from lodequery.llm import url_filter as u

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(lower)
        best = max((r for r in u.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        rows.append([host, path, best and best[0], path.split("/"), ""])
    open_, level = list(rows), 1
    while open_:
        open_ = [r for r in open_ if len(r[3]) > level]
        size = Counter(r[4] for r in open_)
        for r in open_:
            if size[r[4]] < u.MANY:
                r[4] = r[4] + "/" + "/".join(r[3][level:])
        open_ = [r for r in open_ if size.get(r[4], 0) >= u.MANY]
        own, total = Counter((r[0], r[4], r[3][level]) for r in open_), Counter((r[4], r[3][level]) for r in open_)
        variable = lambda counts: sum(n < u.SUPPORT for n in counts) >= u.MANY
        by_host, by_node = {}, {}
        for (h, node, _), n in own.items():
            by_host.setdefault((h, node), []).append(n)
        for (node, _), n in total.items():
            by_node.setdefault(node, []).append(n)
        for r in open_:
            h, node, segment = r[0], r[4], r[3][level]
            counts = by_host[h, node]
            if variable(counts) or sum(counts) >= u.MANY * u.SUPPORT:
                wild = variable(counts) and own[h, node, segment] < u.SUPPORT
            else:
                wild = variable(by_node[node]) and total[node, segment] < u.SUPPORT
            r.append(f"{node}/{'*' if wild else segment}")
        for r in open_:
            r[4] = r.pop()
        level += 1
    leaf = {}
    for host, _, ruling, _, template in rows:
        n, bad = leaf.get((host, template), (0, 0))
        leaf[host, template] = (n + (ruling is not None), bad + (ruling == "block"))
    labelled = [r for r in rows if r[2] is not None]
    rate = sum(r[2] == "block" for r in labelled) / len(labelled) if labelled else 0.0
    across, shares = {}, {}
    for (host, template), (n, bad) in leaf.items():
        m, b = across.get(template, (0, 0))
        across[template] = (m + n, b + bad)
        if n:
            group = shares.setdefault((host, template.rpartition("/")[0]), {})
            m, b = group.get(bad / n, (0, 0))
            group[bad / n] = (m + n, b + bad)
    merged = {}
    for key, group in shares.items():
        branch, last = [], None
        for share in sorted(group):
            n, bad = group[share]
            if last is not None:
                m, b = group[last]
                pooled = (b + bad) / (m + n)
                if share - last > u.Z * math.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n)):
                    branch = []
            branch.append(share)
            for s in branch:
                merged[key, s] = branch
            last = share
    verdicts = []
    for host, _, ruling, _, template in rows:
        n, bad = leaf[host, template]
        if n:
            members = merged[(host, template.rpartition("/")[0]), bad / n]
            n, bad = (sum(shares[host, template.rpartition("/")[0]][s][k] for s in members) for k in (0, 1))
        m, b = across[template]
        purity = (bad + u.PRIOR * (b + u.PRIOR * rate) / (m + u.PRIOR)) / (n + u.PRIOR)
        verdicts.append((ruling or ("block" if purity > 0.5 else "allow"), template, round(purity, 9)))
    return verdicts


def test_url_verdicts_against_brute_force(spark):
    from lodequery.llm import url_filter

    rng = random.Random(11)
    urls = [None, "", "x", "http://h.org", "http://h.org/"]
    for _ in range(1500):
        host = rng.choice(["a.com", "b.net", "c.org", "www.example.com", "example.com", "d.net", f"s{rng.randrange(90)}.org"])
        path = "/".join(rng.choice(["es", "fr", "en", "de", str(rng.randrange(400)), f"p{rng.randrange(6)}"]) for _ in range(rng.randrange(0, 5)))
        urls.append(f"http://{host}/{path}" + rng.choice(["", "?q", "#t", "/"]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.template, round(r.purity, 9)) for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == brute_verdicts(urls)


def test_shards_against_plain_draws(spark):
    import hashlib
    import math
    import zlib

    from lodequery.llm import shards

    def reach(node, key):
        while node.children:
            node = min(node.children, key=lambda c: (-math.log((int(hashlib.md5(f"{key}|{c.path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / c.weight, c.path))
        return node.shard

    rows = [(i, f"text {i}é") for i in range(300)] + [(None, None), (7, "again")]
    tree = shards.regions(16)
    got = shards.place(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), reach(tree, "null" if i is None else i), reach(shards.grown(tree, 16), "null" if i is None else i)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want


@pytest.mark.parametrize("run", ["0" * 10_000, "7" * 10_000])
def test_runs_of_ten_thousand_characters_in_every_kind(spark, run):
    from lodequery.llm import pii

    texts = [f"a {run}1.2.3.4 b", f"a 1.2.3.{run} b", f"x{run}@example.com b", f"a@b{run}.com c", f"card {run} 4111 1111 1111 1111 x", f"+{run} b", f"+1 ({run}) 5", run]
    spans = [pii.base_spans(t) for t in texts]
    zero = run[0] == "0"
    assert [s[0] for s in spans[0]] == (["ip"] if zero else []) and [s[0] for s in spans[1]] == (["ip"] if zero else [])
    assert spans[2] == [("email", 0, 10_013)] and spans[3] == [("email", 0, 10_007)] and spans[4] == spans[5] == spans[6] == spans[7] == []
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip) for r in got] == [(0, int(zero)), (0, int(zero)), (1, 0), (1, 0), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_paths_of_five_hundred_segments(spark):
    """Steps follow branching: one long way with an end that varies, rows that stop on it, and one that leaves it deep down."""
    import time

    from lodequery.llm import url_filter

    deep = "/a/b" * 250
    paths = [f"{deep}/p{i}" for i in range(40)] + ["/a/b" * k for k in range(1, 200, 9)] + ["/a/b" * 120 + "/other/way"]
    rows = spark.createDataFrame([("h.com", p) for p in paths], "host string, path string")
    began = time.time()
    got = {r.path: (r.template, r.parent) for r in url_filter.templates(rows).collect()}
    assert time.time() - began < 60 and set(got) == set(paths)
    for p in paths:
        want = f"{deep}/*" if p.startswith(deep) else p
        assert got[p] == (want, want.rpartition("/")[0])


def test_undone_merges_tell_which_tokens_stay_apart():
    own, rng = bpe.Speculator(bpe.default_path()), random.Random(3)
    made = [t for t in own.halves if own.itself(t) and not own.names[t].endswith(own.suffix)]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(3000)] + [(t, t) for t in made[:1000]]
    pairs += [x for x in rng.sample(sorted(own.merges), 3000) if own.itself(x[0]) and own.itself(x[1])]
    told = [own.apart(*x) for x in pairs]
    assert told == [own.merge(own.atoms(a) + own.atoms(b)) == [a, b] for a, b in pairs] and 500 < sum(told) < len(told) - 500


def test_words_met_again_outlive_the_full_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_CHARS", 400)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    own, learnt = bpe.Speculator(bpe.default_path()), Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learnt.update(words), learn(words)))
    texts = [f"common words {'x' * 40}{chr(97 + i % 26)}{i:03d}{chr(97 + i // 26)} come again" for i in range(300)]
    library = Tokenizer.from_file(bpe.default_path())
    assert [ids for ids, _ in own.encode_batch(texts)] == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert learnt["common"] == learnt["again"] == 1 and sum(map(len, own.known)) + sum(map(len, own.old)) < 1000
