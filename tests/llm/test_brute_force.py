"""Each operator against a plain second implementation, and on very long texts."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from meterline.llm import common, ctw, media, minhash, mixing, packing, passages, secrets, simhash, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


# 2: the set of 5-word shingles under each permutation, in whole numbers


def test_minhash_signatures(table):
    a, b = minhash.permutations()
    text = next(t for t in table.values() if t and len(t.split()) > 40)
    s = np.unique(common.shingle_hashes(common.WordHashes().of(common.words(text)), 5))
    assert len(s) == len({tuple(common.words(text)[i : i + 5]) for i in range(len(common.words(text)) - 4)})
    for k in range(0, 128, 9):
        least = min(((((int(x) & 0xFFFFFFFF) ^ (int(x) >> 32)) * int(a[k]) + int(b[k])) % (1 << 64)) >> 32 for x in s)
        assert minhash.signature(s, a, b)[k] == least


def test_likeness_estimates_jaccard():
    r = random.Random(1)
    a, b = minhash.permutations()
    off = []
    for _ in range(60):
        both, one, two = ([r.getrandbits(64) for _ in range(r.randint(20, 200))] for _ in range(3))
        s, t = (np.unique(np.array(x, np.uint64)) for x in (both + one, both + two))
        off.append(minhash.likeness(minhash.signature(s, a, b), minhash.signature(t, a, b)) - len(both) / (len(both) + len(one) + len(two)))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


# 6: base spans character by character


def base_by_hand(t):
    word, value = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, at = [], 0
    while at < len(t):
        best = None
        for m in [word.match(t, at, at + k) for k in (8, 7, 6, 5)]:
            if m is None or m.start() != at:
                continue
            i = m.end()
            i += i < len(t) and t[i] in "\"'"
            while i < len(t) and t[i] == " ":
                i += 1
            if i < len(t) and t[i] in ":=":
                i += 1
                while i < len(t) and t[i] == " ":
                    i += 1
                i += i < len(t) and t[i] in "\"'"
                j = i
                while j < len(t) and t[j] in value:
                    j += 1
                if j > i:
                    best = (j, i)
                    break
        if best:
            if best[0] - best[1] >= 6:
                out.append((at, best[0], "assign"))
            at = best[0]
        else:
            at += 1
    for kind, head, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(t):
            j = at + len(head)
            if t[at:j] != head:
                at += 1
                continue
            while j < len(t) and t[j] in allowed:
                j += 1
            if j > at + len(head) and j - at >= least:
                out.append((at, j, kind))
            at = max(j, at + 1) if j > at + len(head) else at + 1
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_of_the_whole_table(spark, table):
    got = {r.doc_id: r for r in secrets.op6_secrets(spark, SF).collect()}
    seen = Counter()
    for i, t in table.items():
        spans = base_by_hand(t or "")
        seen.update(k for _, _, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, _, x in spans) for k in ("assign", "access", "hex"))
    assert sum(seen.values()) > 0


def test_models_find_planted_keys_and_leave_words(spark, table):
    """Recall and false positives of the Markov models, letter-only keys among them."""
    r = random.Random(9)
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    table_ = secrets.trained_table(common.documents(spark, SF))
    for letters in alphabets:
        keys = ["".join(r.choices(letters, k=r.choice([24, 32, 40]))) for _ in range(300)]
        assert sum(bool(secrets.random_spans(f"see {k} here", [], table_)) for k in keys) >= 0.9 * len(keys)
    texts = [t for t in table.values() if t]
    flagged = sum(len(secrets.random_spans(t, secrets.base_spans(t), table_)) for t in texts)
    assert flagged <= 0.02 * sum(len(t.split()) for t in texts) / 100


# 7: every piece's ids


def test_packed_ids(spark, table):
    encode = tokens.Encoder(tokens.default_vocabulary())
    ids = {i: encode.whole(t or "") + bytes(4) for i, t in table.items()}
    for r in packing.op7_packing(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


# 8: the cosine transform written out


def test_cosine_hash():
    r = np.random.default_rng(3)
    pixels = r.integers(0, 256, (64, 64)).astype(np.uint8)
    grid = pixels.reshape(32, 2, 32, 2).mean((1, 3))
    low = [[sum(grid[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = np.array(low).round(6).ravel()
    bits = flat > np.median(flat[1:])
    assert media.cosine_hash(pixels) == f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


# 9: files of several frames


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def shard(sizes, frame_bytes=4000):
    out, w = io.BytesIO(), None
    w = tokens.ShardWriter(out, frame_bytes)
    docs = [np.random.default_rng(i).integers(0, 50_000, n).astype("<u4") for i, n in enumerate(sizes)]
    for i, d in enumerate(docs):
        w.add(i if i % 5 else None, d.tobytes())
    w.close()
    return out.getvalue(), docs


def test_only_the_asked_frame_is_decompressed():
    data, docs = shard([300] * 40)
    r = tokens.ShardReader(Source(data))
    assert len(r.table) > 5
    read, plain = [], r.frame_bytes
    r.frame_bytes = lambda k: (read.append(k), plain(k))[1]
    for i in (0, 39, 17):
        assert (r.ids(i) == docs[i]).all()
    assert read == [int(r.frame[i]) for i in (0, 39, 17)]


def test_damage_is_found_in_the_frame_that_has_it():
    data, docs = shard([300] * 40)
    whole = tokens.ShardReader(Source(data))
    at = int(whole.starts[2]) + 20
    bad = tokens.ShardReader(Source(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    import zstandard

    hurt = [i for i in range(40) if int(whole.frame[i]) == 2]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.ids(hurt[0])
    assert (bad.ids(0) == docs[0]).all() and (bad.ids(39) == docs[39]).all()


# very long texts: prose of over a megabyte, one word of a megabyte, and neighbours


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(2)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(5000)]
    prose = " ".join(r.choices(vocab, k=180_000))
    word = "x" * 1_000_000
    assert len(prose) > 1_000_000
    texts = [prose, word, "日本語" * 300_000, "short text of a few words", None, prose]
    return texts, spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_long_texts(spark, long_docs):
    texts, docs = long_docs
    n = len(texts)
    raw = [(t or "").encode() for t in texts]
    terms = ["word", "sho*"]
    size = len(toxicity.Voters(terms)("x")[1])
    model = toxicity.Linear(np.zeros(size), np.ones(size), np.zeros(size + 1))
    assert toxicity.score_toxicity(docs, terms, model).count() == n
    prints = {r.doc_id: r for r in minhash.fingerprint_documents(docs).collect()}
    assert prints[0].fingerprint == prints[5].fingerprint and prints[1].n_chars == 1_000_000
    assert passages.remove_passages(docs).count() == n
    sized, plan = mixing.mix_sources(docs)
    assert {r.doc_id: r["size"] for r in sized.collect()} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    sim = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert sim[5] == sim[0] == 0 and simhash.drop_near_copies(docs).count() == n - 1
    assert secrets.find_secrets(docs, secrets.trained_table(docs)).count() == n
    encode = tokens.Encoder(tokens.default_vocabulary())
    ids = [encode.whole(t.decode()) if i != 1 else None for i, t in enumerate(raw)]
    pieces = packing.packed_documents(docs, tokens.default_vocabulary()).collect()
    assert all(sum(p.length for p in pieces if p.doc_id == i) == len(x) // 4 + 1 for i, x in enumerate(ids) if x is not None)
    made = {r.doc_id: r for r in media.png_features(media.png_column(docs)).collect()}
    assert all(made[i].n_bytes == len(t) and made[i].payload_sha256 == hashlib.sha256(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest() for i, t in enumerate(raw))
    read = {r.doc_id: r for r in tokens.read_shards(tokens.write_shards(docs, common.fresh_path(spark, "long"), tokens.default_vocabulary())).collect()}
    assert all(read[i].ids_crc32 == zlib.crc32(x + (2).to_bytes(4, "little")) for i, x in enumerate(ids) if x is not None)
    scored = {r.doc_id: r for r in ctw.score_documents(docs).collect()}
    assert len(scored) == n and scored[0].score == scored[5].score and scored[0].n_tokens == 180_001


def test_the_encoder_keeps_no_long_chunks():
    e = tokens.Encoder(tokens.default_vocabulary())
    e(["日本語".encode() * 1000, b"y" * 5000, b"few short words"])
    assert max(map(len, e.ids)) <= e.LONG
