"""Alignment of two tokenizers' ids over the same bytes, and which ids stand for which across a corpus.

A token's bytes end somewhere in its text. Where tokens of both vocabularies end, a group of each closes; two tokens are
linked where their bytes overlap. Texts up to ``LONGEST`` bytes are aligned whole. Longer ones are cut into byte ranges
that tasks encode apart; a range gives an open prefix, closed groups and an open suffix, and ranges are put together in a
tree, which is right in any bracketing because what closes depends on the tokens' ends alone.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import by_bytes, documents, record_batch, shuffle_partitions, struct, written
from meterline.llm.tokens import default_vocabulary

#: A text of more bytes is cut into ranges of ``SPAN`` bytes. A chunk, whose link counts are looked up together, holds
#: about ``CHUNK`` bytes of shorter texts.
LONGEST, SPAN, CHUNK = 100_000, 50_000, 12_000_000
FANOUT = 16


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: visible Latin-1 for itself, the others in turn."""
    visible = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: UTF-8 of white space beyond ASCII, as an alternation over bytes.
ODD = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each of the places isn't white space."""
    ok = ~BLANK[data[at - 1]]
    high = np.flatnonzero(data[at - 1] >= 128)
    if len(high):
        p = at[high]
        odd = np.zeros(len(p), bool)
        for c in ODD:
            same = p >= len(c)
            for k, b in enumerate(reversed(c)):
                same &= data[np.maximum(p - 1 - k, 0)] == b
            odd |= same
        ok[high[odd]] = False
    return ok


def unit_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin in joined texts: at each text, and at each space after a character that isn't white space and
    before another character. Neither vocabulary has a token across such a place, so units are encoded and aligned apart."""
    begins = data == 32
    begins[starts] = begins[ends - 1] = False
    at = np.flatnonzero(begins)
    begins[at[~solid_before(data, at)]] = False
    begins[starts] = True
    return np.flatnonzero(begins)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two ascending arrays without repeats all values in order, and those in both."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    again = np.concatenate((both[1:] == both[:-1], [False])) if len(both) else np.zeros(0, bool)
    return both[~again], both[again]


class Tokens:
    """Ids with their ends in a text, of both vocabularies: [ids a, ends a, ids b, ends b]."""

    def __init__(self, a=(), a_end=(), b=(), b_end=()):
        self.a, self.a_end, self.b, self.b_end = (np.asarray(x, np.int64) for x in (a, a_end, b, b_end))

    def __add__(self, other: "Tokens") -> "Tokens":
        return Tokens(*(np.concatenate(x) for x in zip(self.columns(), other.columns(), strict=True)))

    def columns(self):
        return self.a, self.a_end, self.b, self.b_end

    def common(self) -> np.ndarray:
        return merged(self.a_end, self.b_end)[1]

    def between(self, lo: int, hi: int) -> "Tokens":
        """The tokens that end after ``lo``, up to ``hi``."""
        i, j = np.searchsorted(self.a_end, (lo, hi), side="right")
        k, m = np.searchsorted(self.b_end, (lo, hi), side="right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def dump(self) -> list[bytes]:
        return [c.tobytes() for c in self.columns()]

    @classmethod
    def load(cls, columns) -> "Tokens":
        return cls(*(np.frombuffer(c or b"", np.int64) for c in columns))


class Aligner:
    """Both vocabularies in one process. Units met before come from two generations of a dictionary of ``capacity`` bytes
    each (this changes speed only)."""

    ENTRY = 400

    def __init__(self, a_path: str, b_path: str, capacity: int = 25_000_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        chars = byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on from other text into a space")
        self.a_len, self.b_len = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_names, self.b_names = ((names(n, ","), names(n, e)) for n, e in ((len(self.a_bytes), "|"), (len(pieces), ";")))
        self.base = len(pieces)
        self.capacity, self.held, self.new, self.old = capacity, 0, {}, {}

    def encode(self, a_text: bytes, b_text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a stretch of a text in each vocabulary (``b_text`` begins with a space, which the second one adds by
        itself); None where their bytes aren't the text's."""
        a = self.a.encode_batch_fast([a_text.decode()], add_special_tokens=False)[0].ids if a_text else []
        b = self.b.encode(b_text[1:].decode(), num_threads=1) if b_text else []
        if b"".join([self.a_bytes[i] for i in a]) != a_text or b"".join([self.b_bytes[i] for i in b]) != b_text:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def closed(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of tokens whose last ends meet: ends of the groups; ends of the links; the tokens' digits with what follows each,
        in the groups' order; and the links as ``a * base + b``."""
        every, common = merged(t.a_end, t.b_end)
        # between neighbouring ends of any token lies just one overlap
        links = t.a[np.searchsorted(t.a_end, every)] * self.base + t.b[np.searchsorted(t.b_end, every)]
        ga, gb = np.searchsorted(common, t.a_end), np.searchsorted(common, t.b_end)
        out = np.empty(len(t), object)
        for g, own, names, at in ((ga, t.a, self.a_names, np.searchsorted(gb, ga)), (gb, t.b, self.b_names, np.searchsorted(ga, gb, side="right"))):
            last = np.append(g[1:] != g[:-1], True)[: len(g)]
            out[np.arange(len(g)) + at] = np.where(last, names[1][own], names[0][own])
        return common, every, out.tolist(), links

    def _learn(self, units: list[bytes]) -> dict:
        """Each unit's (digits of its groups, links as bytes, tokens a, tokens b, groups); None where bytes differ."""
        found: dict = {}
        a = self.a.encode_batch_fast([[u.decode() for u in units]], is_pretokenized=True, add_special_tokens=False)[0].ids
        b = [i for ids in self.b.encode([u[1:].decode() for u in units], num_threads=1) for i in ids]
        raw = b"".join(units)
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            if len(units) == 1:
                return {units[0]: None}
            half = len(units) // 2
            return self._learn(units[:half]) | self._learn(units[half:])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        t = Tokens(a, np.cumsum(self.a_len[a]), b, np.cumsum(self.b_len[b]))
        common, every, digits, links = self.closed(t)
        upto = lambda x: np.concatenate(([0], np.searchsorted(x, ends, side="right"))).tolist()
        na, nb, ng, nl, packed = upto(t.a_end), upto(t.b_end), upto(common), upto(every), links.tobytes()
        for i, u in enumerate(units):
            x, y = na[i] + nb[i], na[i + 1] + nb[i + 1]
            found[u] = ("".join(digits[x:y]), packed[8 * nl[i] : 8 * nl[i + 1]], na[i + 1] - na[i], nb[i + 1] - nb[i], ng[i + 1] - ng[i])
        return found

    def _keep(self, units: dict) -> None:
        if self.held > self.capacity:
            self.new, self.old, self.held = {}, self.new, 0
        self.held += sum(self.ENTRY + 3 * len(u) + (len(x[0]) + len(x[1]) if x else 0) for u, x in units.items())
        self.new.update(units)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For texts (none empty): tokens a, tokens b, groups and links of each (an array of four columns), the hash of each
        text's groups, and the links of all, one text after another. Zeros and no hash where bytes differ."""
        raw = b" " + b" ".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        begins = unit_starts(np.frombuffer(raw, np.uint8), ends - sizes, ends)
        edges = np.append(begins, len(raw)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        distinct, codes = units.dictionary.to_pylist(), units.indices.to_numpy()
        known = {u: self.new[u] for u in distinct if u in self.new}
        again = {u: self.old[u] for u in distinct if u not in known and u in self.old}
        rest = [u for u in distinct if u not in known and u not in again]
        fresh = {}
        for lo in range(0, len(rest), 20_000):
            fresh |= self._learn(rest[lo : lo + 20_000])
        self._keep(again)
        self._keep({u: x for u, x in fresh.items() if len(u) <= 64})
        entries = [known[u] if u in known else again[u] if u in again else fresh[u] for u in distinct]
        bad = np.array([x is None for x in entries])
        nothing = ("", b"", 0, 0, 0)
        entries = [x or nothing for x in entries]
        bounds = np.searchsorted(begins, np.append(ends - sizes, len(raw)))
        counts = np.array([(x[2], x[3], x[4], len(x[1]) // 8) for x in entries], np.int64).reshape(-1, 4)
        per = np.add.reduceat(counts[codes], bounds[:-1], axis=0)
        wrong = np.logical_or.reduceat(bad[codes], bounds[:-1])
        per[wrong] = 0
        flat, n = np.frombuffer(b"".join([x[1] for x in entries]), np.int64), counts[:, 3]
        start = (np.cumsum(n) - n)[codes]
        n = np.where(np.repeat(wrong, np.diff(bounds)), 0, n[codes])
        upto = np.cumsum(n) - n
        links = flat[np.arange(n.sum()) + np.repeat(start - upto, n)]
        digits, where = [x[0] for x in entries], codes.tolist()
        hashes = []
        for k, w in enumerate(wrong.tolist()):
            text = "".join([digits[c] for c in where[bounds[k] : bounds[k + 1]]])
            hashes.append("" if w else hashlib.sha256(text[:-1].encode()).hexdigest())
        return per, hashes, links


_ALIGNERS: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner: a Python worker keeps it from task to task."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


# -- shorter texts: whole, in chunks whose links are looked up together ---------------------------------------------

SHORT_DDL = "chunk long, doc_id {doc}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs binary, holders binary"


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane: the upper planes of small numbers compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Chunk:
    """Rows of some texts whose links share a sorted dictionary."""

    def __init__(self):
        self.ids, self.per, self.hashes, self.links, self.size = [], [], [], [], 0

    def add(self, ids: list, texts: list[bytes | None], align: Aligner) -> None:
        per, hashes = np.zeros((len(ids), 4), np.int64), [""] * len(ids)
        some = [i for i, t in enumerate(texts) if t]
        if some:
            per[some], own, links = align([texts[i] for i in some])
            for i, h in zip(some, own, strict=True):
                hashes[i] = h
            self.links.append(links)
        self.ids += ids
        self.per.append(per)
        self.hashes += hashes
        self.size += sum(len(t or b"") for t in texts)

    def rows(self, number: int, arrow) -> pa.RecordBatch:
        per = np.concatenate(self.per)
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        pairs, at = np.unique(links, return_inverse=True)
        owner = np.repeat(np.arange(len(per)), per[:, 3])
        held, times = np.unique(owner * max(len(pairs), 1) + at, return_counts=True)
        owner, at = np.divmod(held, max(len(pairs), 1))
        cut = np.searchsorted(owner, np.arange(len(per) + 1)).tolist()
        places = [planes(np.diff(at[i:j], prepend=0)) for i, j in zip(cut, cut[1:], strict=False)]
        often = [planes(times[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        n, holders = len(per), np.bincount(at, minlength=len(pairs))
        columns = [[number] * n, self.ids, *per.T, self.hashes, places, often, [None] * n, [None] * n]
        tail = [number, None, None, None, None, None, None, None, None, pairs.tobytes(), holders.astype(np.int64).tobytes()]
        columns = [pa.array([*(c.tolist() if isinstance(c, np.ndarray) else c), t], f.type) for c, t, f in zip(columns, tail, arrow, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


def short_rows(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """Rows of texts (with their distinct links as places in their chunk's dictionary, and how often), and one row with the
    dictionary for each chunk."""
    ddl = SHORT_DDL.format(doc=docs.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        align, n, chunk = aligner(a_path, b_path), TaskContext.get().partitionId() << 24, Chunk()
        for batch in batches:
            for part in by_bytes(batch, 1, 2_000_000):
                chunk.add(part.column(0).to_pylist(), part.column(1).to_pylist(), align)
                if chunk.size >= chunk_bytes:
                    yield chunk.rows(n, arrow)
                    n, chunk = n + 1, Chunk()
        if chunk.ids:
            yield chunk.rows(n, arrow)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, ddl)


def dictionary_rows(short: DataFrame) -> DataFrame:
    """(chunk, pair, docs): the links of each chunk with the number of its texts that hold them."""
    ddl = "chunk long, pair long, docs long"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        for batch in batches:
            for chunk, pairs, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, h = np.frombuffer(pairs, np.int64), np.frombuffer(holders, np.int64)
                yield record_batch([np.full(len(p), chunk), p, h], arrow)

    return short.where("pairs is not null").select("chunk", "pairs", "holders").mapInArrow(run, ddl)


def looked_up(short: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the texts with what their links count, chunk by chunk."""
    doc = short.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {doc}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = to_arrow_schema(struct(ddl))
    own = dictionary_rows(short).join(counts.select("pair", "docs_all", "best"), "pair").select("chunk", "pair", "docs_all", "best")

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        count = found.column("docs_all").to_numpy()[order]
        best = found.column("best").to_numpy()[order].astype(np.int64)
        n_best, total = [], []
        for places, times in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist(), strict=True):
            at, often = np.cumsum(unplaned(places)), unplaned(times)
            n_best.append(int((best[at] * often).sum()))
            total.append(int((count[at] * often).sum()))
        columns = [texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), texts.column("groups_sha256")], schema=arrow)

    return short.where("pairs is null").drop("pairs", "holders").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, ddl)


# -- longer texts: fragments of byte ranges, composed in a tree ----------------------------------------------------


class Fragment:
    """What a stretch of a text knows by itself: tokens up to its first common end (open to the left), closed groups (given
    out as soon as they close, as bodies), and tokens after its last common end (open to the right). Without a common end
    all is open (``prefix``), and ``closed`` is false. Composition is associative, a fragment without tokens its unit."""

    def __init__(self, prefix: Tokens, suffix: Tokens | None = None):
        self.prefix, self.suffix, self.closed = prefix, suffix or Tokens(), suffix is not None

    @staticmethod
    def of(t: Tokens) -> tuple["Fragment", Tokens]:
        """The fragment of tokens, and those of its closed groups."""
        ends = t.common()
        if not len(ends):
            return Fragment(t), Tokens()
        lo, hi = int(ends[0]), int(ends[-1])
        return Fragment(t.between(-1, lo), t.between(hi, 1 << 62)), t.between(lo, hi)

    def then(self, other: "Fragment") -> tuple["Fragment", Tokens]:
        """This fragment and the one after it as one, and the tokens of the groups that close by that."""
        if not other.closed and not len(other.prefix):
            return self, Tokens()
        if not self.closed and not len(self.prefix):
            return other, Tokens()
        middle = (self.suffix if self.closed else self.prefix) + other.prefix
        seam, body = Fragment.of(middle)
        if not seam.closed:
            return (Fragment(self.prefix, seam.prefix) if self.closed else Fragment(seam.prefix)), Tokens()
        suffix = other.suffix if other.closed else seam.suffix
        return (Fragment(self.prefix, suffix), seam.prefix + body) if self.closed else (Fragment(seam.prefix, suffix), body)


TOKEN_COLUMNS = [f"{side}_{c}" for side in ("pre", "suf") for c in ("a", "a_end", "b", "b_end")]
FRAGMENT_DDL = f"""rid long, seq long, bad boolean, closed boolean, {", ".join(f"{c} binary" for c in TOKEN_COLUMNS)},
  at long, digits string, n_a long, n_b long, n_groups long, pairs binary"""


def fragment_row(rid: int, seq: int, f: Fragment, bad: bool = False) -> dict:
    return {"rid": rid, "seq": seq, "bad": bad, "closed": f.closed} | dict(zip(TOKEN_COLUMNS, f.prefix.dump() + f.suffix.dump(), strict=True))


def loaded(row: dict) -> Fragment:
    tokens = [Tokens.load([row[c] for c in TOKEN_COLUMNS[i : i + 4]]) for i in (0, 4)]
    return Fragment(tokens[0], tokens[1] if row["closed"] else None)


def body_row(rid: int, t: Tokens, align: Aligner) -> list[dict]:
    """Closed groups as a row, known by the byte where the last one ends."""
    if not len(t):
        return []
    common, _, digits, links = align.closed(t)
    return [{"rid": rid, "at": int(common[-1]), "digits": "".join(digits)[:-1], "n_a": len(t.a), "n_b": len(t.b), "n_groups": len(common), "pairs": links.tobytes()}]


A_CUT = re.compile(rb"(?<=[\x21-\x7e])[\x09-\x0d\x20]")
B_CUT = re.compile(rb"(?<=[\x21-\x7e]) (?=.)", re.DOTALL)


def range_pieces(docs: DataFrame, span: int) -> DataFrame:
    """(rid, doc_id, seq, a_start, a_text, b_start, b_text): each text, with the space before it, in pieces that begin at the
    first place from each multiple of ``span`` on where a vocabulary's tokens surely break: for the first one white space
    after a visible ASCII character, for the second one a space after one. So pieces of the two rarely begin together."""
    ddl = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, seq long, a_start long, a_text binary, b_start long, b_text binary"
    arrow = to_arrow_schema(struct(ddl))

    def cuts(data: bytes, pattern) -> list[int]:
        out = [0]
        for lo in range(span, len(data), span):
            m = pattern.search(data, max(lo, out[-1]))
            out.append(m.start() if m else len(data))
        return [*out, len(data)]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rid, doc_id, text = (c[k].as_py() for c in batch.columns)
                data = b" " + text
                a, b = cuts(data, A_CUT), cuts(data, B_CUT)
                for i in range(len(a) - 1):
                    yield record_batch([[rid], [doc_id], [i], [a[i]], [data[a[i] : a[i + 1]]], [b[i]], [data[b[i] : b[i + 1]]]], arrow)

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def fragments(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each piece's fragment, and its closed groups as body rows."""
    arrow = to_arrow_schema(struct(FRAGMENT_DDL))

    def run(batches):
        align = aligner(a_path, b_path)
        for batch in batches:
            for k in range(batch.num_rows):
                rid, seq, a_start, a_text, b_start, b_text = (c[k].as_py() for c in batch.columns)
                ids = align.encode(a_text, b_text)
                if ids is None:
                    yield pa.RecordBatch.from_pylist([fragment_row(rid, seq, Fragment(Tokens()), True)], schema=arrow)
                    continue
                a, b = ids
                f, body = Fragment.of(Tokens(a, a_start + np.cumsum(align.a_len[a]), b, b_start + np.cumsum(align.b_len[b])))
                yield pa.RecordBatch.from_pylist([fragment_row(rid, seq, f), *body_row(rid, body, align)], schema=arrow)

    d = pieces.select("rid", "seq", "a_start", "a_text", "b_start", "b_text")
    return d.repartition(shuffle_partitions(pieces.sparkSession), "rid", "seq").mapInArrow(run, FRAGMENT_DDL)


def tree_round(found: DataFrame, a_path: str, b_path: str, last: bool) -> DataFrame:
    """Fragments of each ``FANOUT`` neighbours as one, with the bodies that close by that; at the root the open prefix, which
    begins with the text, closes too."""
    arrow = to_arrow_schema(struct(FRAGMENT_DDL))

    def run(table: pa.Table) -> pa.Table:
        align, out, whole, bad = aligner(a_path, b_path), [], Fragment(Tokens()), False
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])  # at most FANOUT of them
        rid, seq = rows[0]["rid"], rows[0]["seq"] // FANOUT
        for r in rows:
            bad |= r["bad"]
            whole, body = whole.then(loaded(r))
            out += body_row(rid, body, align)
        if last and not bad:
            if not whole.closed or len(whole.suffix):
                raise ValueError("a text of equal bytes whose last tokens don't end together")
            out += body_row(rid, whole.prefix, align)
            whole = Fragment(Tokens())
        return pa.Table.from_pylist([fragment_row(rid, seq, whole, bad), *out], schema=arrow)

    return found.where("seq is not null").withColumn("up", F.expr(f"seq div {FANOUT}")).groupBy("rid", "up").applyInArrow(lambda t: run(t.drop_columns(["up"])), FRAGMENT_DDL)


def body_pairs(bodies: DataFrame) -> DataFrame:
    """(rid, pair, times): the distinct links of each long text."""
    ddl = "rid long, pair long, times long"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        for batch in batches:
            for rid, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, n = np.unique(np.frombuffer(pairs, np.int64), return_counts=True)
                yield record_batch([np.full(len(p), rid), p, n], arrow)

    return bodies.select("rid", "pairs").mapInArrow(run, ddl).groupBy("rid", "pair").agg(F.sum("times").alias("times"))


def body_hashes(bodies: DataFrame) -> DataFrame:
    """(rid, groups_sha256): bodies stream in order through one hash for each text (it can't be had from parts)."""
    ddl = "rid long, groups_sha256 string"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for rid, digits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rid != now:
                    done += [(now, h.hexdigest())] if h else []
                    now, h = rid, hashlib.sha256()
                else:
                    h.update(b";")
                h.update(digits.encode())
            yield record_batch([list(x) for x in zip(*done, strict=True)] or [[], []], arrow)
        if h:
            yield record_batch([[now], [h.hexdigest()]], arrow)

    n = shuffle_partitions(bodies.sparkSession)
    return bodies.select("rid", "at", "digits").repartition(n, "rid").sortWithinPartitions("rid", "at").select("rid", "digits").mapInArrow(run, ddl)


def long_bodies(docs: DataFrame, a_path: str, b_path: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Of texts cut into ranges: (rid, doc_id), and their bodies; a text whose bytes differ somewhere has none."""
    pieces = written(range_pieces(docs, span), "alignment-pieces")
    found = written(fragments(pieces, a_path, b_path), "alignment-fragments")
    bodies = found.where("at is not null")
    left = pieces.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    while left > 0:
        last = left <= FANOUT
        found = written(tree_round(found, a_path, b_path, last), "alignment-tree")
        bodies = bodies.unionByName(found.where("at is not null"))
        left = 0 if last else -(-left // FANOUT)
    bad = found.where("seq is not null and bad").select("rid")
    return pieces.where("seq = 0").select("rid", "doc_id"), bodies.join(bad, "rid", "left_anti")


def align_documents(docs: DataFrame, a_path: str, b_path: str, longest: int = LONGEST, span: int = SPAN, chunk_bytes: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(per text, links) of all ``docs``.

    per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. links: a, b, docs_all (how many texts
    hold the two ids linked), best (no id of b is linked with a in more texts; ties are all best).

    A null or empty text, and one whose tokens don't give back its bytes, has zeros and an empty hash and counts nowhere.
    Rows with null or equal ids, and repeated rows, each count as a text. Special tokens in a text are plain text. Any
    length goes: a task holds a chunk of short texts or a range of a long one, as long as blanks part it; a text with no
    blank for longer is encoded in one piece there. An empty table gives no rows. Other columns are ignored.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = written(short_rows(docs.where(size <= longest), a_path, b_path, chunk_bytes), "alignment-short")
    ids, bodies = long_bodies(docs.where(size > longest), a_path, b_path, span)
    pairs = written(body_pairs(bodies), "alignment-pairs")
    base = aligner(a_path, b_path).base
    c = dictionary_rows(short).select("pair", "docs").unionByName(pairs.select("pair", F.lit(1).cast("long").alias("docs")))
    c = c.groupBy("pair").agg(F.sum("docs").alias("docs_all")).withColumn("a", F.expr(f"pair div {base}"))
    c = written(c, "alignment-counts")
    most = c.groupBy("a").agg(F.max("docs_all").alias("most"))
    counts = written(c.join(most, "a").select("pair", "a", (F.col("pair") % base).alias("b"), "docs_all", (F.col("docs_all") == F.col("most")).alias("best")), "alignment-links")
    sums = bodies.groupBy("rid").agg(*(F.sum(k).alias(k) for k in ("n_a", "n_b", "n_groups")))
    own = pairs.join(counts, "pair").groupBy("rid").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs_all")).alias("count_sum"),
    )
    long = ids.join(sums, "rid", "left").join(own, "rid", "left").join(body_hashes(bodies), "rid", "left")
    n = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    long = long.select("doc_id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in n), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return looked_up(short, counts).unionByName(long), counts.select("a", "b", "docs_all", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` under the byte-level and the piece vocabulary; nulls, empty and very long texts, repeated rows and
    empty tables as in ``align_documents``."""
    return align_documents(documents(spark, sf_dir), default_vocabulary(), default_pieces())[0]
