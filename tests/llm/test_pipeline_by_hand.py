"""The whole pipeline against plain Python, stage by stage, on the smallest tables and on rows of odd kinds."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import xxhash

import corpus_pipeline
from braidwork.llm import mixing, packing, toxicity

from .test_texts import plain_best_fit

SMALL = "/root/testdata/sf0.001"
MIX, WHOLE = 0x9E3779B97F4A7C15, (1 << 64) - 1
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_features(text):
    words = re.findall(rb"[^\x20\x09-\x0d!-/:-@\[-`{-~]+", (text or "").encode().lower())
    u = [xxhash.xxh64_intdigest(w, 7) for w in words]
    out = {(x * MIX & WHOLE) >> 42 for x in u}
    for gap in (1, 2, 3):
        for a, b in zip(u, u[gap:]):
            x = (a * (2 * gap + 1) & WHOLE) ^ ((b + gap & WHOLE) * MIX & WHOLE)
            out.add(((x ^ x >> 31) * MIX & WHOLE) >> 42)
    return out


def without_toxic(rows, model):
    weight = dict(zip(model.index.tolist(), model.weight.tolist()))
    score = lambda t: 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in toxic_features(t)))))
    return [r for r in rows if score(r[1]) < 0.7]


def without_repeated_lines(rows):
    first, places = {}, []
    order = lambda r: (r[0] is not None, r[0] or 0)
    for r in sorted(rows, key=order):
        lines = [] if r[1] is None else r[1].split("\n")
        for p in range(len(lines) - 2):
            places.append((tuple(lines[p : p + 3]), (r[0], r[1]), p))
            first.setdefault(tuple(lines[p : p + 3]), ((r[0], r[1]), p))
    gone = defaultdict(set)
    for window, doc, p in places:
        if first[window] != (doc, p):
            gone[doc] |= {p, p + 1, p + 2}
    out = []
    for i, t, lang, source, _ in rows:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])
        out.append((i, kept, lang, source, None if kept is None else len(kept)))
    return out


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if r[0] is None or least[find(i)] == r[0]]


def mixed(rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=COLUMNS)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall()}
    return [r for r in rows for _ in range(copies[r[0]])]


def pieces(rows):
    from tokenizers import Tokenizer

    exact, out = Tokenizer.from_file(packing.default_tokenizer()[0]), Counter()
    for r in rows:
        ids = [*exact.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start = 0
        for k in range(-(-len(ids) // 1024)):
            end = start + ((len(ids) - 1) % 1024 + 1 if k == 0 else 1024)
            out[r[0], k, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())] += 1
            start = end
    return out


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), ~toxicity.in_remainder("doc_id", 3, 1))
    plain = [("toxicity", lambda r: without_toxic(r, model)), ("line dedup", without_repeated_lines), ("near-duplicates", without_near_copies), ("mixing", mixed)]
    key = lambda rows: Counter(tuple(map(str, r)) for r in rows)
    began = len(rows)
    for name, by_hand in plain:
        made = stages[name](spark, spark.createDataFrame(rows, docs.schema), SMALL).collect()
        rows = by_hand(rows)
        assert key(made) == key(rows), name
    assert len({r[0] for r in rows}) < began
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == pieces(rows)
    by = defaultdict(list)
    for r in whole:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(by) == plain_best_fit([r.length for r in whole], 1024)
