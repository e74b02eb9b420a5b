"""Cross-tokenizer alignment, vectors in grid order, and importance resampling."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popspark.llm import alignment, embedding_dedup, resampling
from popspark.llm.alignment import Pair, Writer, align, align_texts, common_ends, scored_alignment
from popspark.llm.embedding_dedup import Forest, Interval, embedding_groups, joined
from popspark.llm.resampling import features, importance_scores

ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na b", "don't  stop <|endoftext|> it's", "été à la mer , où ?", "x y 　 z", "日本語 テキスト 日本語",
    "\U0001f600 smile \U0001f600", "tab\tand\x00nul", "a▁b c", "1234 5678 9", "naïve — “quote” …", "é combining", "word " * 300, "<s> </s> <0x41> <unk>",
]


def back_to_bytes():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(rows):
    """Every text by the tokenizers themselves, as a whole."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back, docs, counts = back_to_bytes(), [], Counter()
    for doc_id, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            x = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
            y = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                in_a, in_b = ({int(e): k for k, e in enumerate(np.cumsum([len(z) for z in zs]))} for zs in (x, y))
                n, i, j = (len(a), len(b)), 0, 0
                for e in sorted(in_a.keys() & in_b.keys()):
                    p, q = in_a[e] + 1, in_b[e] + 1
                    groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                    links.append((a[p - 1], b[q - 1]))
                    i, j = p, q
        docs.append((doc_id, *n, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, p, q, len(k), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), s) for d, p, q, k, s in docs]


class TestAlignment:
    @pytest.fixture
    def pair(self):
        import public_tokenizers

        return Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

    def test_gallop(self):
        r = np.random.default_rng(0)
        for n, m in ((0, 5), (1, 1), (3, 4000), (5000, 20), (9000, 9500)):
            a, b = np.unique(r.integers(0, 12_000, n)), np.unique(r.integers(0, 12_000, m))
            i, j = common_ends(a, b)
            assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()

    def test_against_whole_texts(self, spark, pair):
        """Texts with all kinds of spaces and signs, cut into chunks, give what the tokenizers give for the whole."""
        r = random.Random(1)
        made = ["".join(r.choice(["a", "the", "é", "ß", " ", " ", "  ", "\n", "\t", "7", "!", "'s", "日", " ", " ", "😀", "-", "Ω", "ъ"]) for _ in range(r.randint(1, 60))) for _ in range(400)]
        rows = list(enumerate(ODD_TEXTS + made))
        df = spark.createDataFrame([(*x, "x", 1) for x in rows] + [(None, None, "x", 1), (None, "one more", "x", 1), (3, "one more", "x", 1)], "doc_id long, text string, links string, n_a int")
        want = brute_alignment([*rows, (None, None), (None, "one more"), (3, "one more")])
        for common in (alignment.COMMON, 7, 0):
            assert sorted(map(tuple, scored_alignment(df, common=common).collect()), key=str) == sorted(want, key=str)

    def test_long_texts_come_in_parts(self, pair, monkeypatch):
        text = "Der Fluß  war breit, \n und it's naïve. " * 400 + "日本" * 900
        rows = pa.array([None, text, "", text[:50]])
        writer = Writer(60_000)
        whole = align_texts(rows, pair, writer, keep=True)
        monkeypatch.setattr(alignment, "SLICE", 500)
        parts = align_texts(rows, pair, writer, keep=True)
        assert whole[1].n_groups > 1000 and len(parts[1].groups) > 10
        for x, y in zip(whole, parts, strict=True):
            assert (x.fine, x.n_a, x.n_b, x.n_groups, x.text.hexdigest()) == (y.fine, y.n_a, y.n_b, y.n_groups, y.text.hexdigest())
            for k in range(4):
                assert [v for g in x.groups for v in g[k].tolist()] == [v for g in y.groups for v in g[k].tolist()]
        assert [x.fine for x in whole] == [False, True, False, True]

    def test_groups(self, spark):
        df = spark.createDataFrame([(1, "unbelievable tokenization here"), (2, "")], "doc_id long, text string")
        row, empty = align(df, with_groups=True).orderBy("doc_id").collect()
        out = []
        for k in range(row.n_groups):
            i, j = (row.a_stops[k - 1], row.b_stops[k - 1]) if k else (0, 0)
            out.append(",".join(map(str, row.a_ids[i : row.a_stops[k]])) + "|" + ",".join(map(str, row.b_ids[j : row.b_stops[k]])))
        assert hashlib.sha256(";".join(out).encode()).hexdigest() == row.groups_sha256
        assert len(row.links) == 8 * row.n_links and (empty.n_a, empty.groups_sha256, empty.a_ids) == (0, "", [])
        assert scored_alignment(df.limit(0)).count() == 0


def brute_groups(rows, cosine):
    """rows: (vec_id, vector or None). Links by rows, groups by vec_id."""
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def measure(v, w):
        v, w = (np.array(x) / max(map(abs, x)) for x in (v, w))
        return float(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w))

    n = len(rows)
    links = [[j for j in range(n) if j != i and fine(rows[i][1]) and fine(rows[j][1]) and None not in (rows[i][0], rows[j][0]) and len(rows[i][1]) == len(rows[j][1]) and measure(rows[i][1], rows[j][1]) >= cosine] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i]]
        least = vec_id if vec_id is None else min(ids)
        out.append((vec_id, len(links[i]), least, vec_id is None or least == vec_id))
    return sorted(out, key=str)


class TestEmbeddingDedup:
    def test_against_brute_force(self, spark, monkeypatch):
        """Chains of near copies, copies, scaled ones, other dimensions, repeated and null ids, and what cannot take part."""
        monkeypatch.setattr(embedding_dedup, "SMALLEST", 20)
        r = np.random.default_rng(3)
        rows = [(i, r.normal(size=6).tolist()) for i in range(60)]
        rows += [(100 + i, (np.array(rows[i % 5][1]) + r.normal(size=6) * 0.3).tolist()) for i in range(60)]
        rows += [(200 + i, rows[3][1]) for i in range(20)] + [(230 + i, [x * 10.0**e for x in rows[4][1]]) for i, e in enumerate((-3, 3, 170, -170))]
        rows += [(300 + i, r.normal(size=2).tolist()) for i in range(12)] + [(None, rows[0][1]), (None, None), (5, rows[0][1]), (5, rows[0][1])]
        rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None] * 3), (404, [float("nan")] * 6), (405, [float("inf")] * 6), (406, [3.0])]
        df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, vector array<double>, node string, copies int")
        for cosine in (0.9, 0.5):
            got = embedding_groups(df, cosine)
            assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows, cosine)
        assert embedding_groups(df.limit(0)).count() == 0
        assert embedding_groups(df.where("vec_id = 402")).collect() == [(402, 0, 402, True)]

    def test_blocks_that_are_far_apart_do_not_meet(self, spark):
        """Two tight clusters on opposite axes: intervals meet themselves alone."""
        r = np.random.default_rng(4)
        at = np.repeat(np.eye(8)[:2], 100, 0) + r.normal(size=(200, 8)) * 0.01
        df = spark.createDataFrame([(i, x.tolist(), 1, 8) for i, x in enumerate(at)], "node long, vector array<double>, copies long, dims int")
        width = math.sqrt(0.2)
        axes = embedding_dedup.principal_axes(df, 3)
        u = at / np.linalg.norm(at, axis=1)[:, None]
        assert np.allclose(abs(np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :3].T @ axes).round(6), np.eye(3), atol=1e-5)
        few = embedding_dedup.SMALLEST
        embedding_dedup.SMALLEST = 40
        try:
            blocks = embedding_dedup._blocks(df, axes, width)
            pairs = embedding_dedup.block_pairs(blocks, width).collect()
            n = blocks.select("block").distinct().count()
        finally:
            embedding_dedup.SMALLEST = few
        assert n >= 4 and len(pairs) < n * (n + 1) // 2
        place = {x.node: x.block for x in blocks.collect()}
        assert {(min(place[i], place[j]), max(place[i], place[j])) for i in range(100) for j in range(100)} <= set(map(tuple, pairs))

    def test_join_within_a_task(self):
        r = np.random.default_rng(5)
        v = r.normal(size=(900, 5))
        v[300:600] = v[0] + r.normal(size=(300, 5)) * 0.2
        u = v / np.linalg.norm(v, axis=1)[:, None]
        place = np.concatenate([u[:, :2], np.sqrt(1 - (u[:, :2] ** 2).sum(1))[:, None]], 1)
        rows = pa.table({"at": np.arange(900), "node": np.arange(900), "copies": np.ones(900, np.int64), "vector": v.tolist(), "place": place.tolist()})
        want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j}
        whole = Interval(rows)
        assert {p for x, y in joined(whole, whole, 0.9) for p in zip(x, y, strict=True)} == want
        a, b = Interval(rows.slice(0, 400)), Interval(rows.slice(400))
        assert {(i, j + 400) for x, y in joined(a, b, 0.9) for i, j in zip(x, y, strict=True)} == {(i, j) for i, j in want if i < 400 <= j}

    def test_forest(self):
        f = Forest(np.arange(8))
        f.link(np.array([7, 6, 5, 1]), np.array([6, 5, 2, 0]))
        f.link(np.array([3, 7]), np.array([7, 2]))
        assert f.root.tolist() == [0, 0, 2, 2, 4, 2, 2, 2]


def brute_resampling(docs, target, most, buckets, percent, min_words):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    def runs(text):
        w = words(text)
        return Counter(crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1))

    s, t = (sum((runs(x) for x in texts), Counter()) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for k, (doc_id, text) in enumerate(docs):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in runs(text).items())
        out.append([doc_id, len(words(text)), runs(text).total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = rank
    return sorted((tuple(x[:6]) for x in out), key=str)


class TestResampling:
    def test_against_brute_force(self, spark):
        r = random.Random(2)
        pool = ["Alpha", "beta", "gamma-ray", "été", "7UP", "ÀB", "x_y", "日本", "straße", "a\x00b", "the"]
        docs = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for i in range(150)]
        docs += [(500, None), (501, ""), (502, "?!\n"), (None, "beta " * 30), (None, None), (7, "beta " * 25), (7, "beta " * 25)]
        target = ["Alpha été beta"] * 3 + [None, "", "unseen words"]
        df = spark.createDataFrame([(*x, "x", 2) for x in docs], "doc_id long, text string, weight string, `a.b` int")
        goal = spark.createDataFrame([(x,) for x in target], "text string")
        for most, buckets, rows in ((1, 10_000, 500_000), (3, 50, 20)):
            got = importance_scores(df, goal, most=most, buckets=buckets, percent=30, rows=rows)
            assert sorted(map(tuple, got.collect()), key=str) == brute_resampling(docs, target, most, buckets, 30, 20)
        whole = importance_scores(df, goal, with_rows=True).where("doc_id = 3").first()
        assert (whole.document.text, whole.document["a.b"], whole.document.weight) == (docs[3][1], 2, "x")
        assert importance_scores(df.limit(0), goal).count() == 0
        assert importance_scores(df, goal.limit(0)).count() == len(docs)

    def test_slices(self, monkeypatch):
        """A long text's features do not depend on where its slices are cut."""
        r = random.Random(3)
        text = "".join(r.choice("aBcé日- .9") for _ in range(5000))
        whole = [features(text, k) for k in (1, 2, 4)]
        monkeypatch.setattr(resampling, "SLICE", 37)
        assert [features(text, k) for k in (1, 2, 4)] == whole
        assert features("x" * 200, 2) == (1, Counter({crc32(b"x" * 200): 1}))


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "p"), (2, [1.0, 0.01], "q"), (None, [1.0, 0.0], "r")], "vec_id long, `embedding` array<float>, `a.b``c` string")
    kept = embedding_dedup.embedding_dedup(df)
    assert kept.columns == df.columns and sorted(x[2] for x in kept.collect()) == ["p", "r"]
    assert kept.where(F.col("vec_id") == 2).count() == 0
