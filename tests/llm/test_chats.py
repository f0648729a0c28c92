"""Chat formatting, conversation repair and token alignment against brute force."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodequery.llm import alignment, chats, conversations, queries

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    """Conversations with nulls in every column, ties, repeats, odd roles, control strings and a long text; extra columns clash."""
    rng = random.Random(7)
    said = ["Yes.", "no", "What?", "", "  \t", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\| <", "é ß\n日本 !", "a: b\nuser:x.", "word " * 60_000 + "end."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "us er"]
    rows = [(c, rng.choice([t, t, t, 1]), rng.choice(roles[:5] if c % 2 else roles), rng.choice(said[:10])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, r, x) for c in (70, 71, 72) for t, r, x in ((0, "user", "Hi."), (1, "assistant", "Ho!"))] + [(73, 0, "system", "S."), (73, 1, "user", "Q?"), (73, 2, "assistant", said[10])]
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (None, None, None, None), (80, None, "user", "a."), (80, None, "assistant", "b."), rows[0], rows[0]]
    return [(*r, "x", 1, None) for r in rows]


@pytest.fixture(scope="module")
def table(spark, talks):
    return spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string, record string, place int, fault string").repartition(3)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


@pytest.mark.parametrize("most", [chats.RECORD_BYTES, 30])
def test_chats(spark, table, talks, monkeypatch, most):
    monkeypatch.setattr(chats, "RECORD_BYTES", most)
    by: dict = {}
    for c, t, r, x, *_ in talks:
        by.setdefault(c, []).append((c, t, r or "", x or ""))
    got = {r.conv_id: r for r in chats.read_back(chats.format_chats(chats.conversation_records(table), typed_col="typed")).collect()}
    assert got.keys() == by.keys()
    for c, rows in by.items():
        turns = [(r[2], r[3]) for r in in_order(rows)]
        assert [tuple(t) for t in got[c].turns] == [tuple(t) for t in got[c].read_turns] == turns
        assert got[c].loss_texts == [x for r, x in turns if r == "assistant"]
        whole = got[c].formatted
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(turns)
        assert [whole.encode()[s.start : s.end].decode() for s in got[c].loss_spans] == [m[1] for m in re.finditer(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>", whole)]
    assert {got[c].layout for c in (70, 73, 0)} >= ({"prompt_completion", "instruction"} if most > 30 else {"prompt_completion", "typed"})
    assert chats.format_chats(chats.conversation_records(table.limit(0))).count() == 0


def test_layouts(spark):
    user, answer = {"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}
    message = lambda r, x: {"role": r, "content": x}
    cases = [
        ({"messages": [message("user", "q"), message("assistant", "a")], "id": 1, "meta": {"messages": [1]}}, "messages", [user, answer]),
        ({"messages": [message("user", [{"type": "text", "text": "q"}, {"type": "image"}]), message("assistant", "a")], "system": "s"}, "messages", [{"role": "system", "text": "s"}, user, answer]),
        ({"messages": [message("user", "[1, 2]"), message(None, None)]}, "messages", [{"role": "user", "text": "[1, 2]"}, {"role": "", "text": ""}]),
        ({"messages": [], "x`y: <": [[{"z": 1.5}]]}, "no_messages", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "dialogue", [user, answer]),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", [user, answer]),
        ({"prompt": [message("user", "q")], "completion": [message("assistant", "a")]}, "message_pair", [user, answer]),
        ({"prompt": "q", "response": "a"}, "prompt_response", [user, answer]),
        ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [{"role": "user", "text": "q\n\nc"}, answer]),
        ({"instruction": "q", "output": "a", "input": ""}, "instruction", [user, answer]),
        ({"instruction": "q", "output": "a", "messages": [message("user", "q")]}, None, None),
        ({"text": "q"}, None, None), ([1], None, None), (None, None, None),
    ]
    rows = [(i, None if x is None else json.dumps(x), "clash", 3) for i, (x, _, _) in enumerate(cases)] + [(99, "no json", None, None), (100, '{"prompt": "' + "x" * 21_000_000 + '", "completion": "a"}', None, None)]
    records = spark.createDataFrame([r for r in rows if r[0] != 100], "conv_id int, record string, turns string, layout int")
    got = {r.conv_id: r for r in chats.format_chats(records).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i].layout == layout and (turns is None) == (got[i].turns is None) == (got[i].formatted is None), i
        if turns is not None:
            assert [t.asDict() for t in got[i].turns] == turns
    assert got[99].layout is None and len({got[i].fingerprint for i in (0, 4, 5, 6, 7, 8, 9)}) == 7
    long = spark.range(1).select(F.col("id").alias("conv_id"), F.concat(F.lit('{"prompt": "'), F.expr("repeat('x', 21000000)"), F.lit('", "completion": "a"}')).alias("record"))
    assert chats.format_chats(long).select(F.length(F.col("turns")[0]["text"])).first()[0] == 21_000_000


def best_repair(rows):
    """(cost, audit, lines) by trying every edit of every row with up to two insertions before each and at the end."""
    found = None
    gaps = ["", "I", "II"]
    for edits in itertools.product(*[["K", "R", "D"] for _ in rows]):
        if any(e != "D" and r[2] in "bd" and r[2] for e, r in zip(edits, rows, strict=True)):
            continue
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in zip(inserts, (*edits, ""), strict=True))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in audit) + sum(3 for e, r in zip(edits, rows, strict=True) if e != "D" and r[2] == "t")
            if found is not None and (cost, audit) >= found[:2]:
                continue
            roles, lines, left = "", [], list(rows)
            for x in audit:
                role, text, _ = ("", "", "") if x == "I" else left.pop(0)
                if x == "D":
                    continue
                if x != "K":
                    role = "assistant" if roles[-1:] == "u" else "user"
                roles += role[:1] or "?"
                lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles):
                found = (cost, audit, lines)
    return found


def after_damage(talks):
    by: dict = {}
    for c, t, r, x, *_ in talks:
        one = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = "user" if kind == 4 else one(r), "" if kind == 1 else re.sub("[.!?]", "", one(x)) if kind == 2 else one(x)
        by.setdefault(c, []).extend([(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return by


def test_repair(spark, table, talks):
    got = {r.conv_id: r for r in conversations.repair_summaries(conversations.damaged(table)).collect()}
    turns: dict = {}
    for r in conversations.repaired_turns(conversations.damaged(table)).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    damaged = after_damage(talks)
    assert got.keys() == damaged.keys()
    tried = 0
    for c, rows in damaged.items():
        rows, seen, judged = in_order(rows), set(), []
        for _, _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [r[1] for r in rows if r[1] is not None]
        initials = [r[2][:1] for r in rows]
        want = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(x[2] == f for x in judged) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)))
        assert (got[c].gaps, got[c].blank, got[c].duplicate, got[c].truncated, got[c].illegal) == want
        assert got[c].repaired_sha256 == sha("\n".join(turns.get(c, [])))
        if len(judged) <= 5:
            tried += 1
            cost, audit, lines = best_repair(judged)
            assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, sha("\n".join(lines))), judged
    assert tried > 30
    assert conversations.repair_summaries(conversations.damaged(table.limit(0))).count() == 0


def test_a_long_conversation_is_spooled(monkeypatch):
    monkeypatch.setattr(conversations, "SPOOL", 1000)
    talk = conversations.Conversation("1")
    for i in range(2000):
        talk.add(str(i), ("user", "assistant")[i % 2], f"turn {i}.", "")
    assert talk.summary()[6:8] == (0, "K" * 2000) and talk.rows._rolled
    assert sum(1 for _ in talk.repaired()) == 2000


def links_of(aligner, text):
    """The whole text encoded at once, and every pair of tokens compared."""
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    raw = f" {text}".encode()
    sides = []
    for ids, of in ((aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.a_bytes), (aligner.b.encode(text), aligner.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        if b"".join(of[i] for i in ids) != raw:
            return none
        sides.append(out)
    a, b = sides
    pairs = Counter((x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    cuts, groups, low = sorted({x[1] for x in a} & {y[1] for y in b}), [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= cut) for side in sides))
        low = cut
    return len(a), len(b), len(cuts), sum(pairs.values()), ";".join(groups), pairs


ODD = ["a▁b c", "x\x00y  z\n\n é ß 日本語 <|endoftext|> <s> <unk> <0x41> it's  \t ", "I'll can't été è L'été  abc   def ", "  lead", "\n", "ﬁ Å ½ ａ", "é é", "🙂🙂 ok", "a" * 3000, "日本語" * 500, "wörter über straße " * 20]


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 20])
def test_alignment(spark, rows, docs, empty, hot_pairs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text", "id", "row").unionByName(more, allowMissingColumns=True)
    aligner = alignment.Aligner(alignment.default_path("byte_bpe_50k.json"), alignment.default_path("piece_bpe_32k.model"))
    assert aligner.cuts and aligner.lossless
    given = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    told = [(i, links_of(aligner, t)) for i, t in given]
    count: Counter = Counter()
    for _, x in told:
        count.update(x[5])
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter((i, *x[:4], sum(n for p, n in x[5].items() if count[p] == best[p[1]]), sum(n * count[p] for p, n in x[5].items()), sha(x[4]) if x[0] else "") for i, x in told)
    got, totals = alignment.align_documents(both, hot_pairs=hot_pairs)
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == want
    assert {(r.a_id, r.b_id): r.n for r in totals.collect()} == dict(count)
    assert alignment.align_documents(empty)[0].count() == 0


def test_long_texts_by_stretches(monkeypatch):
    aligner = alignment.Aligner(alignment.default_path("byte_bpe_50k.json"), alignment.default_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", ".\n", " -"]) for _ in range(3000))
    whole = aligner.align([text])[0]
    monkeypatch.setattr(alignment, "CHUNK", 700)
    monkeypatch.setattr(alignment, "CACHE_CHARS", 2000)
    parts = aligner.align_long(text)
    assert whole[0] and parts[:5] == (*whole[:4], sha(whole[4][:-1])) and parts[5].tolist() == whole[5].tolist() and parts[6].tolist() == whole[6].tolist()
    assert aligner.align_long(text + " ▁ end")[:5] == (0, 0, 0, 0, "") and [x[0] for x in aligner.align(["ok ▁ no", "ok", ""])][::2] == [0, 0]


@pytest.mark.parametrize("name", ["op11_chats", "op12_repair"])
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.select(*columns).fetchall())


def test_op11_uses_no_python(spark, sf_dir):
    plan = queries.QUERIES["op11_chats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
