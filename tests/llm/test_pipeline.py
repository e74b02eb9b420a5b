"""The pipeline's stages in order, on the smallest tables, and against a brute-force version of all that follows the classifier."""

import collections
import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np

from popspark.llm.common import table
from popspark.llm.quality import quality_scores
from popspark.llm.tokens import default_tokenizer
from tests.llm.test_documents import KINDS, WORD, brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and after and set(after) <= set(before)
        if name in ("quality", "near_dedup", "mixing"):
            assert all(after[i].text == before[i].text for i in after)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(after)


def brute_lines(docs):
    """docs {id: text} without the lines that another one keeps."""
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = collections.defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    gone = lambda i, x: len(held.get(key(x), ())) >= 3 and i != max(held[key(x)])
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}


def water(nodes, budget):
    """{name: granted} of nodes (name, capacity, weight)."""
    out, weight = {}, sum(w for _, _, w in nodes)
    ordered = sorted(nodes, key=lambda n: (n[1] / n[2], n[0]))
    for k, (name, capacity, w) in enumerate(ordered):
        if capacity * weight > budget * w:
            return out | {n: budget * v // weight for n, _, v in ordered[k:]}
        out[name] = capacity
        budget, weight = budget - capacity, weight - w
    return out


def brute_mix(docs):
    """The ids that four fifths of all words, in target weights, reach; docs {id: (text, lang, source)}."""
    words = {i: len(re.findall(WORD, t)) for i, (t, _, _) in docs.items()}
    leaf = {}
    for i, (_, lang, source) in docs.items():
        number = re.search("([0-9]{1,9})$", source or "")
        leaf[i] = (f"d{int(number[1]) % 4 if number else 0}", lang or "", source or "")
    cap = collections.Counter()
    for i, path in leaf.items():
        for k in (1, 2, 3):
            cap[path[:k]] += words[i]
    domain, language = {"d0": 400, "d1": 300, "d2": 200, "d3": 100}, {"en": 600, "de": 150, "fr": 150, "es": 100}
    weigh = [lambda n: domain[n], lambda n: language.get(n, 100), lambda n: 100]
    grant = {(): sum(words.values()) * 800 // 1000}
    for k in (1, 2, 3):
        for parent in {p[: k - 1] for p in cap if len(p) == k and cap[p]}:
            nodes = [(p[-1], cap[p], weigh[k - 1](p[-1])) for p in cap if len(p) == k and p[:-1] == parent and cap[p]]
            grant |= {(*parent, n): g for n, g in water(nodes, grant[parent]).items()}
    kept = set()
    for path in {p for p in cap if len(p) == 3 and cap[p]}:
        at = 0
        for i in sorted((i for i in docs if leaf[i] == path and words[i]), key=lambda i: hashlib.md5(f"17:0:{i}".encode()).hexdigest()):
            if at < grant[path]:
                kept.add(i)
            at += words[i]
    return kept


def test_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(7)
    good, bad = ["river", "stone", "light", "grass", "cloud", "bread", "north", "seven"], ["BUY", "$$$", "click", "win", "!!!"]
    shared = ["a line that very many of the documents hold", "Another line that some of them hold", "x"]
    rows, labels = [], []
    for i in range(260):
        fine = i % 4 != 0
        lines = [" ".join(r.choice(good if fine else bad) + (str(r.randrange(30)) if fine else "") for _ in range(r.randint(6, 30))) for _ in range(r.randint(1, 4))]
        if fine and r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        rows.append((i, "\n".join(lines), r.choice(["en", "de", None]), f"src{r.randrange(6)}", 0))
        labels.append((i, int(fine), 0))
    for i in range(260, 330):
        words = rows[r.randrange(260)][1].split(" ")
        if r.random() < 0.5:
            words[r.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words), "en", "src1", 0))
    rows += [(330, None, "en", "src1", 0), (331, "", None, None, 0)]
    spark.createDataFrame(rows, KINDS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    fine = quality_scores(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")).where("predicted = 1").collect()
    texts = brute_lines({x.doc_id: x.text or "" for x in fine})
    ids = sorted(texts)
    groups = brute_groups([texts[i] for i in ids], 5, 80, 100)
    alone = {i: texts[i] for k, i in enumerate(ids) if groups[k][1] == k}
    assert len(alone) < len(texts)
    meta = {x[0]: x[2:4] for x in rows}
    kept = brute_mix({i: (t, *meta[i]) for i, t in alone.items()})
    assert 0 < len(kept) < len(alone)
    tokens = Tokenizer.from_file(default_tokenizer())
    want = {i: [*tokens.encode(alone[i], add_special_tokens=False).ids, 1] for i in kept}
    parts = collections.defaultdict(dict)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(p.ids) == p.ids_crc32
        parts[p.doc_id][p.start] = np.frombuffer(p.ids, "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
