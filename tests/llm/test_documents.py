"""Operators on documents: small cases by hand, and brute-force versions on random ones."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.llm.binary_output import best_fit, pack_matrices, write_matrices
from popspark.llm.components import components
from popspark.llm.line_dedup import line_dedup
from popspark.llm.mixing import mix
from popspark.llm.near_dedup import Bands, estimate, near_dedup, near_groups, registers
from popspark.llm.packing import retrieval_pack
from popspark.llm.quality import quality_scores
from popspark.llm.substring_dedup import substring_dedup
from popspark.llm.tokens import default_tokenizer
from popspark.llm import words as W
from popspark.llm.words import shingles, word_hashes

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, KINDS)


def prose(n, seed, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 150))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


class TestLineDedup:
    SHARED = "a line that several documents share"

    def test_cases(self, spark):
        upper = f"\t {self.SHARED.upper()}\x0b "
        texts = [self.SHARED, f"{upper}\nmine", f"x\n{self.SHARED}\n{self.SHARED}", None, "", "short\nshort", "short", "short", "É" + self.SHARED, "é" + self.SHARED]
        got = {r.doc_id: r for r in line_dedup(frame(spark, texts).withColumnRenamed("n_chars", "N_LINES")).collect()}
        assert got[0].text == "" and got[0].n_dropped == 1
        assert got[1].text == "mine" and (got[1].n_lines, got[1].n_dropped) == (2, 1)
        assert got[2].text == texts[2] and got[2].n_dropped == 0
        assert (got[3].text, got[3].n_lines) == ("", 1) and (got[4].text, got[4].n_lines) == ("", 1)
        assert got[5].n_dropped == 0 and got[8].n_dropped == 0

    def test_rows_of_one_id(self, spark):
        """Rows that repeat a doc_id are one document: here three documents hold the line, and then two."""
        texts = [f"{self.SHARED}\nx", f"y\n{self.SHARED}", self.SHARED, "z", self.SHARED]
        docs = frame(spark, texts, [1, 1, 2, 1, 3]).withColumnRenamed("lang", "drops").withColumnRenamed("source", "a.b")
        out = line_dedup(docs)
        assert sorted(r.text for r in out.collect()) == sorted(["x", "y", "", "z", self.SHARED]) and set(docs.columns) < set(out.columns)
        assert sorted(r.text for r in line_dedup(docs.where("doc_id < 3")).collect()) == sorted(texts[:4])

    def test_names_that_clash(self, spark):
        docs = frame(spark, [self.SHARED, self.SHARED + "\nx", self.SHARED])
        for name in ("_dropped", "_lines", "_gone", "row", "body", "version", "lines", "gone", "keeper", "k"):
            got = line_dedup(docs.withColumnRenamed("lang", name)).collect()
            assert sorted(r.text for r in got) == sorted(["", "x", self.SHARED]) and all(r[name] in (None, "en") for r in got)

    def test_against_sql_with_repeated_rows(self, spark, tmp_path):
        import duckdb

        from popspark.llm.line_dedup import SQL

        r = random.Random(4)
        pool = [f"line number {i} of the pool of lines" for i in range(6)]
        texts = ["\n".join(r.choice([*pool, "", "mine"]) for _ in range(r.randint(1, 5))) for _ in range(40)]
        frame(spark, texts).where("doc_id is not null").write.parquet(str(tmp_path / "d"))
        once = spark.read.parquet(str(tmp_path / "d"))
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
        want = {(x[0], x[3]) for x in con.sql(SQL).fetchall()}
        twice = line_dedup(once.unionByName(once)).collect()
        assert len(twice) == 80 and {(x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in twice} == want

    def test_very_long_text(self, spark):
        long = "\n".join([self.SHARED, *(f"line {i}" for i in range(200_000)), self.SHARED])
        got = {r.doc_id: r for r in line_dedup(frame(spark, [long, self.SHARED, self.SHARED])).collect()}
        assert (got[0].n_lines, got[0].n_dropped) == (200_002, 2) and got[0].text == long[len(self.SHARED) + 1 : -len(self.SHARED) - 1]

    def test_repeated_rows_and_null_ids(self, spark):
        got = line_dedup(frame(spark, [self.SHARED] * 4, [7, 7, 7, None])).collect()
        assert all(r.text == self.SHARED for r in got)

    def test_empty(self, spark):
        assert line_dedup(frame(spark, []).limit(0)).count() == 0

    def test_against_brute_force(self, spark):
        r = random.Random(1)
        pool = [f"line number {i} of the pool of lines" for i in range(12)]
        texts = ["\n".join(r.choice(pool) if r.random() < 0.5 else str(r.random()) * 3 for _ in range(r.randint(1, 9))) for _ in range(60)]
        docs = collections.defaultdict(set)
        for i, t in enumerate(texts):
            for x in t.split("\n"):
                if len(x.strip()) >= 20:
                    docs[x.strip().lower()].add(i)
        want = {i: "\n".join(x for x in t.split("\n") if not (len(d := docs.get(x.strip().lower(), ())) >= 3 and i != max(d))) for i, t in enumerate(texts)}
        assert {x.doc_id: x.text for x in line_dedup(frame(spark, texts)).collect()} == want


def brute_groups(texts, n, num, den):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = []
    for t in texts:
        w = re.findall(WORD, (t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    part = list(range(len(texts)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def copies(texts, seed):
    r = random.Random(seed)
    out = list(texts)
    for t in texts:
        for _ in range(r.choice([0, 1, 3])):
            w = t.split(" ")
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
            out.append(" ".join(w))
    r.shuffle(out)
    return out


class TestNearDedup:
    @pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
    def test_against_brute_force(self, spark, n, num):
        texts = [*copies(prose(40, n), n), None, "", "one", "ONE", "two words", "Two\twords", "İ ı", "i ı"]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(spark, texts), n, num, 100).collect()}
        assert got == brute_groups(texts, n, num, 100)

    def test_one_large_group(self, spark):
        """Copies with an edit each are nearer to their origin than to one another."""
        base = prose(1, 5, 2000)[0].split(" ") * 1
        base = [f"w{i}" for i in range(60)]
        texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(3, 57)] + [" ".join(base)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(spark, texts), 3, 85, 100).collect()}
        assert got == brute_groups(texts, 3, 85, 100)

    def test_rows_that_repeat_and_nulls(self, spark):
        docs = frame(spark, ["a b c d", "a b c d", "A B C D", None], [3, 3, None, None])
        got = near_groups(docs).collect()
        assert [r.component_id for r in got if r.doc_id == 3] == [3, 3]
        assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
        assert near_groups(docs.limit(0)).count() == 0
        assert sorted(r.text or "" for r in near_dedup(docs).collect()) == ["", "A B C D", "a b c d"]

    def test_ids_with_several_texts(self, spark):
        """Each text of document 2 is near to another document's, so all three are one group; 9 repeats itself only."""
        t, u = (" ".join(f"{k}{i}" for i in range(40)) for k in "tu")
        docs = frame(spark, [t, t + " z", u, u + " y", "lone text of nine", "another text of nine"], [1, 2, 2, 3, 9, 9])
        got = near_groups(docs).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)} and len(got) == 6
        assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [1, 9]

    def test_columns_stay(self, spark):
        docs = frame(spark, ["a b c d e f"] * 3).withColumnRenamed("lang", "key").withColumnRenamed("source", "_row").withColumnRenamed("n_chars", "a.b")
        out = near_dedup(docs)
        assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]

    def test_estimate(self):
        r = np.random.default_rng(0)
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 300, 300))
        one, other = (registers(np.unique(np.concatenate([both, x]))) for x in (a, b))
        assert abs(estimate(one, other[None])[0] - 3000 / 3600) < 0.2
        assert estimate(one, one[None])[0] > 0.99

    def test_similar_sets_share_a_key(self):
        r = np.random.default_rng(1)
        bands = Bands(85, 100)
        for n in (1, 6, 7, 20, 60, 130, 140, 400, 3000):
            for _ in range(20):
                x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
                d = int(0.15 * n / 1.15)
                y = np.unique(np.concatenate([x[d:], r.integers(0, 2**63, d).astype(np.uint64)]))
                if len(np.intersect1d(x, y)) * 100 >= 85 * len(np.union1d(x, y)):
                    assert len(np.intersect1d(bands.keys(registers(x), len(x)), bands.keys(registers(y), len(y))))

    @pytest.mark.parametrize(("num", "small", "large"), [(80, 4, 5), (80, 8, 10), (80, 12, 15), (85, 6, 7), (85, 7, 8), (85, 12, 13), (85, 12, 14), (85, 17, 20)])
    def test_short_sets_always_share_a_key(self, num, small, large):
        bands, r = Bands(num, 100), np.random.default_rng(small)

        def keys(hashes):
            regs = registers(hashes)
            return np.concatenate([bands.keys(regs, len(hashes)), bands.least(regs, hashes)])

        for hashes in r.integers(0, 1 << 64, (4000, large), dtype=np.uint64):
            assert np.isin(keys(np.sort(hashes[:small])), keys(np.sort(hashes))).any()

    def test_short_texts_are_linked(self, spark):
        """Each text once more with a word appended: 4 of 5 runs of 5 words are the same."""
        texts = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(300)]
        got = {r.doc_id: r.component_id for r in near_groups(frame(spark, texts + [t + " more" for t in texts])).collect()}
        assert [got[i + 300] for i in range(300)] == list(range(300))

    def test_components(self, spark):
        r = random.Random(3)
        links = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
        part = {}

        def find(i):
            part.setdefault(i, i)
            while part[i] != i:
                i = part[i]
            return i

        for a, b in links:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


class TestLongTexts:
    def test_words_are_hashed_alike_in_slices(self, monkeypatch):
        import pyarrow as pa

        texts = ["A" * 30_000 + " b " + "c" * 9000, "x" * 10_001, "one two", "", " ", "é" * 6000 + "\t" + "z" * 4095]
        whole = [x.tolist() for x in word_hashes(pa.array(texts), lower=True)]
        for size in (64, 4096, 10_000):
            monkeypatch.setattr(W, "SLICE", size)
            assert [x.tolist() for x in word_hashes(pa.array(texts), lower=True)] == whole
        assert [len(x) for x in whole] == [3, 1, 2, 0, 0, 2] and len({h for x in whole for h in x}) == 8

    def test_tokens_in_slices(self, monkeypatch):
        """Long texts, with spaces or without, have the ids that the tokenizer gives them as a whole."""
        import pyarrow as pa
        from tokenizers import Tokenizer

        from popspark.llm import tokens as T

        t, r = Tokenizer.from_file(default_tokenizer()), random.Random(4)
        texts = [*TRICKY, "a1b2" * 500 + " x", "".join(r.choice("abcXYZ0123456789+/=") for _ in range(3000)), "x" * 900, "don't it's 5't " * 90]
        monkeypatch.setattr(T, "SLICE", 200)
        got = list(T.word_tokens(default_tokenizer()).encode(pa.array(texts, pa.string())))
        assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]

    def test_indicators_in_slices(self, monkeypatch):
        from popspark.llm import quality as Q

        text = " ".join(prose(3, 8)).encode() + "é日本".encode()
        words = np.arange(50, dtype=np.uint64)
        whole = Q.Indicators().of(text, words).tolist()
        for size in (3, 64):
            monkeypatch.setattr(Q, "SLICE", size)
            assert Q.Indicators().of(text, words).tolist() == whole

    def test_groups_beyond_a_slice(self, spark, monkeypatch):
        long = " ".join(f"w{i}" for i in range(600_000))
        got = near_groups(frame(spark, [long, long + " more", "x " * 10])).collect()
        assert len(long) > W.SLICE and sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2)]


class TestSubstringDedup:
    @pytest.mark.parametrize("bits", [64, 9, 3])
    def test_against_brute_force(self, spark, bits):
        """With few bits, different words, windows and paths have equal hashes; the words decide all the same."""
        r = random.Random(2)
        passages = [" ".join(f"p{k}w{i}" for i in range(r.randint(30, 60))) for k in range(6)]
        texts = [None, "", "again " * 80, "again " * 34, "x y " * 40, "x y " * 40, "again " * 36, "\x1cone\xa0two " * 20, "q " * 70 + passages[0] + " q" * 50]
        for t in prose(60 if bits == 64 else 25, 9):
            words = t.split(" ")
            for _ in range(r.randint(0, 2)):
                words.insert(r.randrange(len(words) + 1), r.choice(passages))
            texts.append(r.choice([" ", "\n", "\t"]).join(words))
        texts += texts[-5:]
        split = [re.findall(WORD, t or "") for t in texts]
        count = collections.Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
        got = {x.doc_id: x for x in substring_dedup(frame(spark, texts), bits=bits).collect()}
        for i, w in enumerate(split):
            gone = {q for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for q in range(k, k + 35)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            assert (got[i].n_words, got[i].n_removed, got[i].text, got[i].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())

    def test_paths_are_compacted(self, spark):
        """A path of 20 edges in three texts is one run in each of them, up to where one of the texts leaves it; an edge that
        comes again and again ends a run."""
        from popspark.llm.substring_dedup import _compacted

        edges = [(d, 0, p * 10 + at, p * 10 + at + 9, p + 1, 1) for d, at in ((0, 0), (1, 0), (2, 7)) for p in range(20) if not (d == 1 and p >= 12)]
        edges += [(3, 0, 0, 9, 13, 1), (3, 0, 10, 49, 14, 4)]
        got = sorted((r.doc, r["first"], r["last"]) for r in _compacted(spark.createDataFrame(edges + edges[:9], "doc long, version long, first long, last long, piece long, copies int")).collect())
        want = [(0, 0, 119), (0, 120, 129), (0, 130, 139), (0, 140, 199), (1, 0, 119), (2, 7, 126), (2, 127, 136), (2, 137, 146), (2, 147, 206), (3, 0, 9), (3, 10, 49)]
        assert got == want

    def test_repeated_ids(self, spark):
        long = " ".join(map(str, range(50)))
        got = substring_dedup(frame(spark, [long, "other", long, None], [1, 1, 1, None])).collect()
        assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in got) == [(False, 1, 0), (False, 50, 50), (False, 50, 50), (True, 0, 0)]
        assert substring_dedup(frame(spark, []).limit(0)).count() == 0

    def test_null_ids_and_equal_checksums(self, spark):
        """Rows without doc_id, two of them with one CRC-32, are cleaned each by its own places; very long texts as well."""
        tail = " ".join(f"t{i}" for i in range(60))
        texts = [f"plumless {tail}", f"buckeroo {tail}", f"a b {tail} c", "short one", None, "short one", tail * 2, " ".join(map(str, range(300_000)))]
        got = substring_dedup(frame(spark, texts, [None] * 8)).collect()
        assert sorted((r.n_words, r.n_removed, r.text[:30]) for r in got) == sorted([(61, 60, "plumless"), (61, 60, "buckeroo"), (63, 60, "a b c"), (2, 0, "short one"), (0, 0, ""), (2, 0, "short one"), (119, 118, "t59t0"), (300_000, 0, " ".join(map(str, range(300_000)))[:30])])


TRICKY = ["It's DON'T 'Re a1b22 x<|endoftext|>y", "é É ß ẞ İ a b \x1c c\x85d ́e é", "日本 abc\u200bdef ΑΣ ς `q` a-b_c", None, "", " \n\t", "word " * 5000]


class TestPacking:
    def want(self, texts):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(default_tokenizer())
        return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]

    def test_every_token_once(self, spark):
        texts = TRICKY + prose(300, 4)
        want = self.want(texts)
        out = retrieval_pack(frame(spark, texts), shard_tokens=20_000).collect()
        parts = collections.defaultdict(dict)
        fill = collections.defaultdict(dict)
        for p in out:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.doc_tokens == len(want[p.doc_id])
            parts[p.doc_id][p.start] = ids.tolist()
            fill[p.sequence_id][p.offset] = p.length
        for i, ids in enumerate(want):
            assert [x for s in sorted(parts[i]) for x in parts[i][s]] == ids
        for places in fill.values():
            at = 0
            for offset in sorted(places):
                assert offset == at
                at += places[offset]
            assert at <= 2048 and at & (at - 1) == 0

    def test_neighbours_meet(self, spark):
        """Two subjects, mixed up: a window's documents are mostly of one."""
        r = random.Random(0)
        words = {k: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(200)] for k in (0, 1)}
        texts = [" ".join(r.choice(words[i % 2]) for _ in range(100)) for i in range(120)]
        docs = frame(spark, texts).coalesce(1)
        by = collections.defaultdict(list)
        for p in retrieval_pack(docs, window=1024).collect():
            by[p.sequence_id].append(p.doc_id % 2)
        pure = [max(x.count(0), x.count(1)) / len(x) for x in by.values() if len(x) > 2]
        assert sum(pure) / len(pure) > 0.8

    def test_scores(self):
        """Against BM25 written out, with the frequencies of a corpus that is larger than the shard."""
        from popspark.llm.packing import B, K1, Bm25, Corpus, Piece

        r = np.random.default_rng(0)
        pieces = [Piece(i, 0, r.integers(0, 40, r.integers(1, 30)).astype(np.uint32), 0) for i in range(60)]
        df = np.array([sum(t in p.ids for p in pieces) for t in range(40)]) * 3
        corpus = Corpus(df, 200, 17.0)
        index = Bm25(pieces, corpus)
        for k in range(0, 60, 7):
            want = []
            for p in pieces:
                score = 0.0
                for t in set(pieces[k].ids.tolist()):
                    if (tf := int((p.ids == t).sum())) and df[t] > 3:
                        score += np.log(1 + (200 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p.ids) / 17.0))
                want.append(score)
            assert np.allclose(index.scores(k), want)

    def shard(self, n=400, seed=1):
        """Pieces of two subjects, some of them alike, and their corpus."""
        from popspark.llm.packing import Corpus, Piece

        r = np.random.default_rng(seed)
        pieces = [Piece(i, 0, (r.zipf(1.3, r.integers(1, 90)) % 300 + 100 * (i % 2)).astype(np.uint32), 0) for i in range(n)]
        pieces += [Piece(n + i, 0, pieces[i].ids, 0) for i in range(20)]
        df = np.bincount(np.concatenate([np.unique(p.ids) for p in pieces]), minlength=400)
        return pieces, Corpus(df, len(pieces), sum(len(p.ids) for p in pieces) / len(pieces))

    def test_scores_without_used_pieces(self):
        from popspark.llm.packing import Bm25

        pieces, corpus = self.shard()
        whole, index = Bm25(pieces, corpus), Bm25(pieces, corpus)
        left = np.arange(len(pieces))
        for seed in range(3):
            kept = np.random.default_rng(seed).random(len(left)) < 0.6
            index.keep(kept)
            left = left[kept]
            for k in range(0, len(left), 5):
                others = np.arange(len(left)) != k
                assert (index.scores(k) == whole.scores(left[k])[left])[others].all()

    def test_shard_is_packed_greedily(self, monkeypatch):
        """The windows of a plain greedy search over all scores, for less work: used pieces are not scored again and again."""
        from popspark.llm.packing import Bm25, pack_shard

        for window in (100, 300):
            pieces, corpus = self.shard(seed=window)
            index, rest, want = Bm25(pieces, corpus), list(pieces), []
            while sum(len(p.ids) for p in rest if p) >= window:
                seed = next(i for i, p in enumerate(rest) if p)
                scores, space = index.scores(seed), window
                order = [seed, *sorted((i for i in range(len(rest)) if i != seed), key=lambda i: (-scores[i], i))]
                want.append([])
                for i in (i for i in order if rest[i]):
                    n = len(rest[i].ids)
                    part, tail = rest[i].split(space)
                    want[-1].append((part.doc_id, part.start, len(part.ids)))
                    rest[i] = tail if n > space else None
                    space -= len(part.ids)
                    if not space:
                        break
            work, score = [], Bm25.scores
            monkeypatch.setattr(Bm25, "scores", lambda *a: (work.append(out := score(*a)), out)[1])
            windows, tail = pack_shard(pieces, window, corpus)
            monkeypatch.undo()
            assert [[(p.doc_id, p.start, len(p.ids)) for p in w] for w in windows] == want
            assert sorted((p.doc_id, p.start) for p in tail) == sorted((p.doc_id, p.start) for p in rest if p)
            assert sum(map(len, work)) < 0.7 * len(windows) * len(pieces)

    def test_words_are_tokenized_once(self):
        """600,000 different words, read twice."""
        import pyarrow as pa

        from popspark.llm.tokens import WordTokens

        encoder, seen = WordTokens(default_tokenizer()), []
        tokenize = encoder.model.tokenize

        class Model:
            def tokenize(self, word):
                seen.append(word)
                return tokenize(word)

        encoder.model = Model()
        letters = "abcdefghijklmnopqrstuvwxyz"
        words = ["".join(letters[i // 26**k % 26] for k in range(5)) for i in range(600_000)]
        texts = pa.array([" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)])
        first = [x.tolist() for x in encoder.encode(texts)]
        assert [x.tolist() for x in encoder.encode(texts)] == first
        assert len(seen) == len(set(seen)) == len(words)
        assert first[0] == encoder.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids

    def test_cache_that_starts_anew(self, monkeypatch):
        import pyarrow as pa

        import popspark.llm.tokens as T

        texts = TRICKY[:-1] + prose(60, 8) + [None, "", "\t", "ÀB'c 12 .. a.b A1"]
        want = [ids[:-1] for ids in self.want(texts)]
        for words, size in ((1, 8), (20, 300), (1_000_000, 1 << 24)):
            monkeypatch.setattr(T, "WORDS", words)
            monkeypatch.setattr(T, "SLICE", size)
            encoder = T.WordTokens(default_tokenizer())
            for column in (pa.array(texts), pa.array(["left out", *texts, "x"], pa.large_string()).slice(1, len(texts))):
                for _ in range(2):
                    assert [x.tolist() for x in encoder.encode(column)] == want
        assert [x.tolist() for x in encoder.encode(pa.array([None, ""], pa.string()))] == [[], []]

    def test_copies_far_apart_meet(self, spark):
        """Two texts on each of many subjects, read in different partitions, stand in one window."""
        r = random.Random(3)
        words = [["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for _ in range(40)]
        texts = [" ".join(r.choice(words[i]) if k % 2 else "common words" for k in range(100)) for i in range(40)]
        docs = frame(spark, texts + [t + " end" for t in texts]).repartition(7, "text")
        of = {p.doc_id: p.sequence_id for p in retrieval_pack(docs, shard_tokens=30_000).orderBy("length").collect()}
        assert sum(of[i] == of[i + 40] for i in range(40)) >= 30

    def test_empty(self, spark):
        assert retrieval_pack(frame(spark, []).limit(0)).count() == 0
        assert pack_matrices(frame(spark, []).limit(0)).count() == 0

    def test_matrices(self, spark, tmp_path):
        texts = TRICKY + prose(100, 6)
        want = self.want(texts)
        write_matrices(pack_matrices(frame(spark, texts), window=512, shard_tokens=8000), str(tmp_path / "packed"), 512)
        parts = collections.defaultdict(dict)
        for r in spark.read.parquet(str(tmp_path / "packed")).collect():
            ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
            assert len(ids) == len(positions) == 512 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
            assert zlib.crc32(r.ids) == r.ids_crc32 and zlib.crc32(r.positions) == r.positions_crc32
            for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                parts[d][s] = ids[a:b].tolist()
                assert positions[a:b].tolist() == list(range(b - a))
        for i, ids in enumerate(want):
            assert [x for s in sorted(parts[i]) for x in parts[i][s]] == ids

    def test_best_fit(self):
        r = random.Random(1)
        lengths = [r.randint(1, 100) for _ in range(500)]
        bins = best_fit(lengths, 100)
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 100) - n)
        assert sorted(i for b in bins for i in b) == list(range(500)) and len(bins) == len(rooms)
        assert sorted(100 - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


class TestQuality:
    def test_learns(self, spark):
        r = random.Random(0)
        good = [" ".join(r.choice(["the", "of", "river", "stone", "light", "and"]) for _ in range(40)) for _ in range(150)]
        bad = [" | ".join(r.choice(["buy", "click", "$$$", "win"]) for _ in range(20)) for _ in range(100)]
        docs = frame(spark, good + bad + [None, ""])
        labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(250)], "doc_id long, quality int, toxic int")
        got = {x.doc_id: x for x in quality_scores(docs.withColumnRenamed("n_chars", "Score"), labels).collect()}
        held = [i for i in range(250) if zlib.crc32(str(i).encode()) % 5 == 0]
        assert np.mean([got[i].predicted == (i < 150) for i in held]) > 0.97
        assert all(0 <= x.score <= 1 for x in got.values()) and got[250].score == got[251].score

    def test_few_labels(self, spark):
        docs = frame(spark, ["a", None])
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
        one = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
        assert {r.predicted for r in quality_scores(docs, one).collect()} == {1}
        assert quality_scores(docs.limit(0), one).count() == 0


def test_quality_of_odd_names(spark):
    docs = frame(spark, ["a good text", None]).withColumn("a`b.c", F.lit(1)).withColumn("Score", F.lit("x"))
    from popspark.llm.quality import quality_scores

    out = quality_scores(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    assert "a`b.c" in out.columns and "Score" not in out.columns and out.count() == 2


class TestClassifier:
    """The parts of the classifier against their definitions."""

    def sample(self, n=80, terms=30, seed=0):
        r = np.random.default_rng(seed)
        rows = [np.flatnonzero(r.random(terms) < np.where(np.arange(terms) < 15, 0.3 + 0.2 * (i % 2), 0.3)) for i in range(n)]
        return [x if len(x) else np.array([0]) for x in rows], np.arange(n) % 2

    def test_ratios(self):
        from popspark.llm.quality import SIZE, ratios

        rows, labels = self.sample()
        got = ratios(rows, labels)
        for t in range(30):
            count = [sum(t in x for x, y in zip(rows, labels, strict=True) if y == k) + 1 for k in (0, 1)]
            total = [sum(len(x) for x, y in zip(rows, labels, strict=True) if y == k) + SIZE for k in (0, 1)]
            assert np.isclose(got[t], np.log(count[1] / total[1]) - np.log(count[0] / total[0]))

    def test_descent_reaches_the_optimum(self):
        """The primal value is that of the best of many subgradient steps, and no lower bound is passed: the gap closes."""
        from popspark.llm.quality import descend

        rows, labels = self.sample()
        y = labels * 2.0 - 1
        values = [np.ones(len(x)) / len(x) ** 0.5 for x in rows]
        x = np.zeros((len(rows), 31))
        for i, (places, v) in enumerate(zip(rows, values, strict=True)):
            x[i, places] = v
        x[:, 30] = 1
        w, bias = descend(rows, values, y, 1.0, 2000, 0)
        primal = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (x @ u)).sum()
        got = primal(np.append(w[:30], bias))
        u, best = np.zeros(31), np.inf
        for k in range(1, 20_001):
            u -= (u - x.T @ (y * (y * (x @ u) < 1))) / k
            best = min(best, primal(u))
        assert got <= best + 1e-3 * abs(best)

    def test_held_out_rows_do_not_matter(self, spark):
        """Labels of the held-out fifth, other columns and the order of rows change no score."""
        texts = [f"{'fine words here' if i % 2 else 'buy now cheap'} {i % 7} {i}" for i in range(120)]
        labels = [(i, i % 2, 0) for i in range(120)]
        held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(120)]
        kinds = "doc_id long, quality int, toxic int"
        one = quality_scores(frame(spark, texts), spark.createDataFrame(labels, kinds)).collect()
        turned = [(i, 1 - q if held[i] else q, 1) for i, q, _ in labels][::-1]
        other = quality_scores(frame(spark, texts).repartition(3).withColumn("lang", F.lit("x")), spark.createDataFrame(turned, kinds)).collect()
        assert {r.doc_id: r.score for r in one} == {r.doc_id: r.score for r in other}


class TestMixing:
    def test_shortage_goes_to_siblings(self, spark):
        """src0 to src3 are the four domains; d3's only leaf is small, so the other domains give what it cannot."""
        sizes = {"src0": 40, "src1": 40, "src2": 40, "src3": 1}
        texts, sources = zip(*[("w " * 10, s) for s, n in sizes.items() for _ in range(n)], strict=True)
        docs = spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], KINDS)
        got = mix(docs, per_mille=500, epochs=1).groupBy("domain").sum("taken").collect()
        by = {r.domain: r["sum(taken)"] for r in got}
        assert by == {"d0": 264, "d1": 198, "d2": 132, "d3": 10}

    def test_prefix_and_epochs(self, spark):
        docs = frame(spark, ["a b c", None, "", *prose(30, 3)])
        out = mix(docs, per_mille=1500, epochs=2).collect()
        leaves = collections.defaultdict(list)
        for r in out:
            leaves[r.domain, r.lang, r.source].append(r)
        for taken in leaves.values():
            taken.sort(key=lambda r: r.leaf_start)
            at = 0
            for k, r in enumerate(taken):
                assert r.leaf_start == at and r.taken == (r.tokens if k < len(taken) - 1 else r.taken) and 0 < r.taken <= r.tokens
                at += r.taken
            assert [r.epoch for r in taken] == sorted(r.epoch for r in taken)

    def test_weights_are_parameters(self, spark):
        """Uneven weights of sources, other domains: shares against hand-made water filling."""
        from popspark.llm.mixing import Weights

        sizes = {"web": 50, "books": 30, "code": 20, "rest": 10}
        rows = [(k, i, s) for k, (s, i) in enumerate((s, i) for s, n in sizes.items() for i in range(n))]
        docs = spark.createDataFrame([(k, "w " * 10, "en", s, 0) for k, _, s in rows], KINDS)
        weights = Weights(source={"web": 100, "books": 500, "code": 300}, other=100, domain_of=lambda s: F.lit("all"))
        got = {r.source: r["sum(taken)"] for r in mix(docs, per_mille=500, epochs=1, weights=weights).groupBy("source").sum("taken").collect()}
        # 550 tokens: books would get 275, code 165, web and rest 55; all fit.
        assert got == {"books": 275, "code": 165, "web": 55, "rest": 55}
        more = {r.source: r["sum(taken)"] for r in mix(docs, per_mille=900, epochs=1, weights=weights).groupBy("source").sum("taken").collect()}
        # 990 tokens: books and code are full at 300 and 200, rest at 100; web gives what is left.
        assert more == {"books": 300, "code": 200, "rest": 100, "web": 390}

    def test_repeated_rows(self, spark):
        docs = frame(spark, ["a b", "a b", "c d e"], [1, 1, 1])
        out = mix(docs, per_mille=1000, epochs=1).collect()
        assert sorted(r.text for r in out) == ["a b", "a b", "c d e"]
        assert mix(docs.limit(0)).count() == 0

    def test_weight_zero_and_nulls(self, spark):
        """A source or language of weight 0 gives nothing, whatever room is left; null names and ids are rows like others."""
        from popspark.llm.mixing import Weights

        rows = [(i, "w " * 10, "en", s, 0) for i, s in enumerate(["web"] * 20 + ["books"] * 10 + ["spam"] * 10)]
        rows += [(None, "w " * 10, None, None, 0)] * 3 + [(None, f"w{i} " * 10, "xx", "web", 0) for i in range(4)]
        docs = spark.createDataFrame(rows, KINDS).withColumn("Tokens", F.lit("mine")).withColumn("a`b.c", F.lit(1))
        weights = Weights(source={"spam": 0}, lang={"xx": 0}, domain_of=lambda s: F.lit("all"))
        for share, want in ((1000, {"web": 200, "books": 100, "": 30}), (500, {"web": 92, "books": 92, "": 30})):
            out = mix(docs, per_mille=share, epochs=1, weights=weights)
            assert {r.source: r["sum(taken)"] for r in out.groupBy("source").sum("taken").collect()} == want or share == 500
            assert {r.source for r in out.collect()} == set(want) and out.columns.count("tokens") == 1 and "Tokens" not in out.columns and "a`b.c" in out.columns
        none = Weights(other=0)
        assert mix(docs, per_mille=1000, weights=none).count() == 0 and mix(docs.limit(0), weights=none).count() == 0
        with pytest.raises(ValueError, match="negative"):
            Weights(other=-1)
        # Rows without doc_id come back whole, each with its own text.
        back = mix(docs, per_mille=1000, epochs=1, weights=Weights(domain_of=lambda s: F.lit("all"))).where("doc_id is null").collect()
        assert sorted(r.text for r in back) == sorted(r[1] for r in rows if r[0] is None)
