"""Alignment of tokenizers, sharding, and repair of conversations, each against a plain second implementation."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterline.llm import alignment, conversations, mixing, sharding
from meterline.llm.tokens import default_vocabulary

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# 11


def plain_alignment(rows):
    """Token by token, whole texts, all in memory."""
    a_model = Tokenizer.from_file(default_vocabulary())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    chars, names = alignment.byte_level(), {i: t for t, i in a_model.get_vocab().items()}
    docs = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(chars[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        a_at, b_at = np.cumsum([0, *map(len, a_bytes)]).tolist(), np.cumsum([0, *map(len, b_bytes)]).tolist()
        shared = sorted(set(a_at) & set(b_at))
        groups = [([i for i, e in zip(a, a_at[1:]) if lo < e <= hi], [i for i, e in zip(b, b_at[1:]) if lo < e <= hi]) for lo, hi in zip(shared, shared[1:])] if len(text) < 3000 else None
        links, j = [], 0
        for i in range(len(a)):
            while b_at[j + 1] <= a_at[i]:
                j += 1
            k = j
            while k < len(b) and b_at[k] < a_at[i + 1]:
                links.append((a[i], b[k]))
                k += 1
        docs.append((doc_id, a, b, groups if groups is not None else (len(shared) - 1), links))
    held = Counter(p for d in docs for p in set(d[4]))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        digits = None if isinstance(groups, int) else hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), groups if isinstance(groups, int) else len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digits))
    return out


def same(found, plain):
    known = [(r, p) for r, p in zip(ordered(found), ordered(plain), strict=True)]
    assert [r if p[-1] is not None else (*r[:-1], None) for r, p in known] == [p for _, p in known]


TEXTS = [
    (None, "x y"), (1, None), (2, ""), (3, " "), (4, "a "), (5, "  two  spaces  "), (6, "a▁b c"), (7, "<|endoftext|> <s> </s> <0x0A>"), (8, "tab\there\nnl \r\n x"),
    (9, "nb sp 　wide x"), (11, "\x1c x \x1f y\x85 z"), (12, "日本語 テキスト"), (17, "ab\ncd\tef gh  ij"), (17, "ab\ncd\tef gh  ij"), (19, "\U0001f44d\U0001f3fd emoji x﻿y"),
    (20, "don't I'll  we've\n 's"), (22, "\n\nx"), (23, "foo\n bar\t baz \n qux, end."),
]


@pytest.mark.parametrize(("longest", "span", "chunk"), [(100_000, 50_000, 12_000_000), (8, 3, 60), (0, 5, 1)])
def test_alignment_is_the_plain_one_however_texts_are_cut(spark, longest, span, chunk):
    d = spark.createDataFrame([(*r, "x", 7) for r in TEXTS], "doc_id long, text string, chunk string, pair long").repartition(3)
    found, links = alignment.align_documents(d, default_vocabulary(), alignment.default_pieces(), longest, span, chunk)
    plain = plain_alignment(TEXTS)
    same(found.collect(), plain)
    assert sum(r[4] > 0 for r in plain) > 10 and found.columns[0] == "doc_id"
    assert links.agg(F.sum("docs_all")).first()[0] >= links.count()


def test_alignment_of_the_table_and_of_long_texts(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    same(alignment.op11_alignment(spark, SF).collect(), plain_alignment(rows))
    long = [(1, "word, number 12 line\n\n" * 9000), (2, "x" * 120_000), (3, "日本語。" * 9000), (4, "ab\ncd\tef gh  ij " * 9000), (4, "ab\ncd\tef gh  ij " * 9000), (5, "bad▁ " + "foo bar " * 20_000), (6, "short one")]
    d = spark.createDataFrame(long, "doc_id long, text string").repartition(3)
    same(alignment.align_documents(d, default_vocabulary(), alignment.default_pieces(), span=7000)[0].collect(), plain_alignment(long))


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found, links = alignment.align_documents(none, default_vocabulary(), alignment.default_pieces())
    assert found.collect() == links.collect() == []


def test_fragments_compose_in_any_bracketing():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 60)
        ends = lambda: np.array(sorted({*r.sample(range(1, n + 1), r.randint(1, n)), n}))
        a, b = ends(), ends()
        whole = alignment.Tokens(np.arange(len(a)), a, 100 + np.arange(len(b)), b)
        k = r.randint(1, 6)
        cut_a, cut_b = ([0, *sorted(r.randint(0, n) for _ in range(k - 1)), n] for _ in range(2))
        parts = []
        for i in range(k):
            x, y = (a > cut_a[i]) & (a <= cut_a[i + 1]), (b > cut_b[i]) & (b <= cut_b[i + 1])
            parts.append(alignment.Tokens(whole.a[x], a[x], whole.b[y], b[y]))

        def fold(own):
            """A fragment of the parts, bracketed at random, and the ends of the groups that closed."""
            if len(own) == 1:
                f, body = alignment.Fragment.of(own[0])
                return f, body.common().tolist()
            m = r.randint(1, len(own) - 1)
            (f, x), (g, y) = fold(own[:m]), fold(own[m:])
            h, body = f.then(g)
            return h, x + y + body.common().tolist()

        f, closed = fold(parts)
        assert f.closed and not len(f.suffix)
        assert sorted(closed + f.prefix.common().tolist()) == whole.common().tolist()


# 12


def test_shards_are_those_of_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert ordered(sharding.op12_sharding(spark, SF).collect()) == ordered(con.sql(sharding.ORACLE_OP12).fetchall())


def test_shards_of_odd_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, *range(30)]), r.choice([None, "", "x" * r.randint(0, 50), "éé"]), "s", 5) for _ in range(300)] + [(7, "same", "s", 5)] * 150
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, part long").repartition(7)
    out = sharding.balanced_shards(d)
    assert out.columns == ["doc_id", "text", "part", "shard", "slot"]
    got = out.collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x[0], x[1]) for x in rows)
    size = lambda t: len((t or "").encode()) + 1
    total, most, last = sum(size(x[1]) for x in rows), max(size(x[1]) for x in rows), (-1, -1)
    for s in range(8):
        own = sorted((x for x in got if x.shard == s), key=lambda x: x.slot)
        assert [x.slot for x in own] == list(range(len(own)))
        assert abs(sum(size(x.text) for x in own) - total / 8) <= most
        keys = [(x.doc_id is not None, x.doc_id or 0) for x in own]
        assert keys == sorted(keys) and (not keys or keys[0] >= last)
        last = keys[-1] if keys else last
    assert ordered(sharding.balanced_shards(d).collect()) == ordered(got)
    sharding.write_balanced(d, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 450
    assert sharding.balanced_shards(spark.createDataFrame([], d.schema)).collect() == []
    one = sharding.balanced_shards(spark.createDataFrame([(1, "x" * 1000), (2, "y")], "doc_id long, text string"), 3).collect()
    assert [(x.doc_id, x.slot) for x in sorted(one, key=lambda x: x.doc_id)] == [(1, 0), (2, 0)]


# 13


def plain_repair(rows):
    """All edits that may still win, by a search over whole audits."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            x = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not x else "duplicate" if (role, text) in seen else "truncated" if x[-1] not in ".!?" else None)
            seen.add((role, text))

        def inserted(paths):
            more = set(paths)
            for _ in range(2):
                more |= {(c + 3, a + "I", q2, o + (name[s] + ":",)) for c, a, q, o in more for s, q2 in after[q].items() if s in name and a[-2:] != "II"}
            return more

        paths = {(0, "", "", ())}
        for (_, role, text), fault in zip(own, faults, strict=True):
            new = set()
            for c, a, q, o in inserted(paths):
                new.add((c + 4, a + "D", q, o))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    for s, q2 in after[q].items():
                        if s == role[:1]:
                            new.add((c + more, a + "K", q2, (*o, f"{role}:{text}")))
                        elif s in name:
                            new.add((c + more + 3, a + "R", q2, (*o, f"{name[s]}:{text}")))
            least = min(p[0] for p in new)
            paths = {p for q in after for p in sorted(x for x in new if x[2] == q and x[0] <= least + 6)[:12]}
        cost, audit, _, o = min(p for p in inserted(paths) if p[2] in ("", "a"))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        n = Counter(faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(o).encode()).hexdigest()))
    return out


def test_repair_of_the_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
        found = ordered(conversations.op13_conversation_repair(spark, sf).collect())
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
        assert found == ordered(plain_repair(rows)) == ordered(con.sql(conversations.ORACLE_OP13).fetchall())


@pytest.mark.parametrize("held", [4_000_000, 300])
def test_repair_of_odd_and_of_very_long_conversations(spark, held):
    g = random.Random(3)
    role = lambda: g.choice(["user", "assistant", "system", "tool", None, ""])
    rows = [(g.choice([None, *range(7)]), g.choice([None, *range(40)]), role(), g.choice([None, "", "a.", "b", "c d!", "  "])) for _ in range(400)]
    rows += rows[:50] + [(9, i, g.choice(["user", "assistant"]), f"turn {i % 700}.") for i in range(3000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, rows long").repartition(5)
    assert ordered(conversations.repaired_conversations(conversations.damaged(d), held).collect()) == ordered(plain_repair(rows))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired_conversations(conversations.damaged(none)).collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"5:{i}".encode()) % 20 == 0)
    (r,) = conversations.repaired_conversations(conversations.damaged(spark.createDataFrame([(5, gone, "user", "x.")], none.schema))).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_stacks_of_the_role_grammar():
    auto = conversations.Automaton()
    for text, ok in (("", True), ("s", False), ("ua", True), ("sua", True), ("suaua", True), ("uau", False), ("su", False)):
        top = 0
        for c in text:
            top = auto.shift[top][c]
        assert auto.ends[top] is ok
    with pytest.raises(ValueError, match="differently"):
        conversations.Automaton((("c", "t"), ("c", "stu"), ("t", "ua")), "c")


# 4


def test_mixing_takes_no_column_for_its_row_number(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.withColumn("a_row", F.col("doc_id") % 3).write.parquet(str(tmp_path / "documents.parquet"))
    assert ordered(mixing.op4_mixing(spark, str(tmp_path)).collect()) == ordered(mixing.op4_mixing(spark, SF).collect())
