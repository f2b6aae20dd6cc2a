"""The operators against brute force, round trips and held-out texts, with odd rows."""

import collections
import math
import os
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridion.llm import ann, components, licenses, lines, near, packing, pieces, pii, quality, queries, sharding, topk

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ODD = [
    (1, None, "x"), (2, "", "x"), (3, "   \n\t ", "x"), (4, BASE, None), (5, BASE, "copy"), (5, BASE, "repeated row"), (6, BASE.replace("upsilon", "omega"), "near"),
    (None, "text without an id", "x"), (8, LONG, "long"), (9, "one\ntwo\none\n" + BASE, "lines"), (10, "mail a.b@mail7.example.com or +1 (017) 555-7713 or 97.51.17.173 today", "pii"), (11, "日本 🎉 text with\x0bodd  spaces", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, 7, "clash") for i, t, s in ODD], "doc_id long, text string, source string, n_chars long, shard string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_sharding(odd, empty):
    got = sharding.external_shuffle(odd, 5, bucket_bytes=100_000)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "source", "n_chars", "shard", "slot"]
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == collections.Counter(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(by[k]) for k in range(5)]
    assert max(n) - min(n) <= 1
    assert sharding.external_shuffle(empty, 5).count() == 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_sharding_digest(spark, docs):
    rows = {r["doc_id"]: r for r in sharding.op8_sharding(spark, FOLDER).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        assert (rows[r["doc_id"]]["size"], rows[r["doc_id"]]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(odd).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, _ in ODD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        copies = 2 if i == 5 else 1
        parts = sorted(by[i, len(ids)], key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids) * copies
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_packing_takes_the_tokenizers_ids(spark):
    """Special tokens in a text, long documents and windows that fill on the way."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    texts = {0: "hello <|endoftext|> world", 1: "<|endoftext|>", 2: " ".join(f"w{k}" for k in range(9000))}
    texts |= {k: " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randint(1, 900))) for k in range(3, 120)}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    filled = collections.Counter()
    for r in rows:
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        filled[r["sequence_id"]] += r["length"]
    assert sum(n < packing.WINDOW for n in filled.values()) <= 1 and sorted(filled) == list(range(min(filled), min(filled) + len(filled)))


def test_sentencepiece_digest(odd):
    c = pieces.codec(pieces.default_model())
    for r in pieces.digest(odd).collect():
        text = next(t for i, t, _ in ODD if i == r["doc_id"]) or ""
        ids = c.reference.encode(text)
        assert (r["n_tokens"], r["ids_crc32"], r["decoded_crc32"], r["parity"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(text.encode()), True)
        assert c.decode([ids]) == [c.reference.decode(ids)] == [text]


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in ODD)
    assert max(back.groupBy("shard").count().toPandas()["count"]) - min(back.groupBy("shard").count().toPandas()["count"]) <= 1
    assert sharding.bucket_size(spark) >= sharding.LEAST_BYTES


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", 5, 6)], "doc_id long, text string, gone long, of_id long")
    assert [tuple(r) for r in lines.dedup(df).collect()] == [(1, "a b c", 5, 6)]


def test_packing_level_is_the_best(spark):
    rng = random.Random(1)
    p = packing.Packer(64)
    for d in range(300):
        n = rng.randint(1, 63)
        before = p.level.copy()
        cost = {}
        for h in range(64 - n + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + n] += h + n < 64
            cost[h] = int((after[1:64] ** 2).sum())
        p.add(d, n)
        assert int((p.level[1:64] ** 2).sum()) == min(cost.values())
    got = collections.Counter()
    for pieces_ in p.windows():
        assert sum(x[2] for x in pieces_) <= 64
        for d, _, n in pieces_:
            got[d] += n
    assert len(got) == 300


def test_pieces(odd, empty):
    sp = pieces.codec(pieces.default_model()).reference
    for r in pieces.encode_documents(odd).collect():
        text = next(t for i, t, _ in ODD if i == r["doc_id"]) or ""
        assert list(r["ids"]) == sp.encode(text) and r["parity"] and r["decoded"] == text
    assert pieces.digest(empty).count() == 0


def test_unigram_model():
    def message(*parts):
        out = b""
        for number, value in parts:
            if isinstance(value, int):
                out += bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
            elif isinstance(value, float):
                import struct

                out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            else:
                out += bytes([number << 3 | 2, len(value)]) + value
        return out

    made = message(*[(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in (("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1))], (2, message((3, 1))), (3, message((3, 1), (4, 0))))
    codec = pieces.Codec(made)
    assert codec.model.kind == pieces.UNIGRAM
    assert all(ok for *_, ok in codec.encode(["ab a b", "a ab", "bab"]))


def brute_lines(rows, t=0.8):
    first, every = {}, []
    for i, text in rows:
        for k, line in enumerate((text or "").lower().split("\n")):
            s = frozenset(line.split())
            if s and i is not None:
                every.append((i, k, s))
                first[s] = min(first.get(s, (i, k)), (i, k))
    gone = {a for a in first for b in first if first[b] < first[a] and len(a & b) >= t * len(a | b) - 1e-9}
    return {(i, k) for i, k, s in every if first[s] < (i, k) or s in gone}


def test_lines(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] != 8 or df is docs]
        got = {tuple(r) for r in lines.removed_lines(df.filter("doc_id <> 8 or doc_id is null") if df is odd else df).collect()}
        assert got == brute_lines(rows)
    out = {(r["doc_id"], r["source"]): r for r in lines.dedup(odd).collect()}
    assert len(out) == len(ODD) and out[None, "x"]["text"] == "text without an id" and out[1, "x"]["text"] is None
    assert out[9, "lines"]["text"] == "one\ntwo" and out[9, "lines"]["n_chars"] == 7 and out[5, "copy"]["text"] == ""
    assert lines.dedup(empty).count() == 0


def test_near_copies_of_lines(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(30)] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in lines.removed_lines(df).collect()} == brute_lines(rows)


def brute_near(rows, t=0.8):
    sets, root = {}, {}
    for i, text in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([(i, None)])
    cls = {}
    for i in sorted(sets):
        cls.setdefault(sets[i], i)
    reps = {c: s for s, c in cls.items()}
    links = collections.Counter()
    root = {c: c for c in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and len(reps[a] & reps[b]) >= t * len(reps[a] | reps[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (cls[s], links[cls[s]], find(cls[s])) for i, s in sets.items()}


def test_near(docs, odd, empty, spark):
    rng = random.Random(4)
    group = []
    for i in range(420):  # more than two blocks
        words = [f"w{k}" for k in range(120)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        group.append((i, " ".join(words)))
    for df in (docs, odd, spark.createDataFrame(group, "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = {(r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in near.near_duplicates(df).collect()}
        assert got == {(i, *v) for i, v in brute_near(rows).items()}
    assert near.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, BASE), (1, BASE.replace("upsilon", "omega")), (2, BASE + " end"), (3, None), (3, "a b c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near.near_duplicates(twice).select("doc_id", "n_links", "group_id").collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]


def test_levels():
    """The level of a size: deepest with which a pair as unlike as the size allows is found with the target chance."""
    assert near.least_similarity(3) is None and near.least_similarity(4) == 4 / 5 and near.least_similarity(7) == 6 / 7
    assert near.levels(3) is None and near.levels(7) == 8 and near.levels(6) == 7 and near.levels(500) == 6
    for n in range(4, 80):
        k = near.levels(n)
        x = near.least_similarity(n) if n < near.SIZES else near.THRESHOLD
        reached = lambda d: 1 - (1 - x**d) ** near.TREES >= near.RECALL  # noqa: E731, B023
        assert reached(k) and (k == near.DEPTH or not reached(k + 1))


def test_forest_shortens_prefixes(spark):
    """Each class ties at its own levels: 1 and 2 share six bytes, 3 and 4 (which stop at 8) share seven, 5 and 6 all."""
    sig = lambda *x: int.from_bytes(bytes(x), "big", signed=True)
    head = (200, 1, 2, 3, 4, 5)
    rows = [(1, 6, [sig(*head, 1, 1)]), (2, 6, [sig(*head, 9, 9)]), (3, 8, [sig(*head, 4, 1)]), (4, 8, [sig(*head, 4, 2)]), (5, 8, [sig(*head, 5, 5)]), (6, 8, [sig(*head, 5, 5)]), (7, 6, [sig(7, *head, 0)])]
    got = {tuple(r) for r in near.forest(spark.createDataFrame(rows, "cid long, floor int, signatures array<long>")).collect()}
    assert got == {(2, 1, 6), (6, 5, 8)}
    brute = {(x[0], y[0], k) for x in rows for y in rows for k in range(6, 9) if x[0] != y[0] and max(x[1], y[1]) <= k and x[2][0] >> 8 * (8 - k) == y[2][0] >> 8 * (8 - k)}
    assert {(min(a, b), max(a, b)) for a, b, _ in got} == {(min(a, b), max(a, b)) for a, b, _ in brute}


def test_forest_recall(spark):
    """Pairs just over the threshold: nearly all are linked."""
    rng, rows = random.Random(12), []
    for i in range(400):
        words = [f"w{i}_{k}" for k in range(64)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + [f"x{rng.random()}"]) if i % 2 else " ".join(words[6:]))]
    want = brute_near(rows)
    got = {r["doc_id"]: r["n_links"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[i][1] for i in got) > 700 and sum(got.values()) >= 0.995 * sum(want[i][1] for i in got)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == r for x, r in root.items())


def naive(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) < 256 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_patterns(docs):
    rng = random.Random(8)
    texts = [r["text"] or "" for r in docs.collect()] + ["".join(rng.choice("ab1.2@+-( )35%_0") for _ in range(200)) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == naive(t)


def test_model_on_unseen_texts():
    import pickle

    rng = random.Random(991)
    made = [pii.generate(rng, 300) for _ in range(150)]
    got = pii.Reader(pickle.loads(pii.trained())).tag([t for t, _ in made])
    hit = total = found = 0
    for (_, y), g in zip(made, got, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
        gold = {(int(s), int(y[s]) - 1, int(e)) for s, e in zip(edge[:-1], edge[1:], strict=True) if y[s]}
        hit, total, found = hit + len(gold & set(g)), total + len(gold), found + len(g)
    assert hit / total > 0.85 and hit / found > 0.85


def test_windows_agree_with_whole_texts():
    import pickle

    reader = pii.Reader(pickle.loads(pii.trained()))
    span = "jan.someone (at) mail-host (dot) example (dot) com"
    for before in range(pii.WINDOW - pii.OVERLAP - 60, pii.WINDOW + 10, 7):  # the span lies at every place of a cut
        head = ("the of " * 200)[:before]
        text = f"{head} {span} " + "the of " * 60
        assert (before + 1, 0, before + 1 + len(span)) in pii.all_spans(text, [], reader.tag([text])[0]), before


def test_reconciled():
    assert pii.reconciled([(-5, 10, 0, 30), (-2, 10, 0, 18), (-1, 20, 0, 30), (-1, 30, 1, 40)]) == [(10, 0, 30), (30, 1, 40)]


def test_personal_data_digest(docs, odd):
    """Counts and checksums by the naive patterns; base spans stay, and the model finds the secrets that no pattern states."""
    import hashlib

    for df in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
        got = pii.find(df).collect()
        assert len(got) == df.count()
        by = {r["doc_id"]: r for r in got}
        for i, text in texts:
            base, r = naive(text or ""), by[i]
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
            spans = r["spans"].split(",") if r["spans"] else []
            assert set(filter(None, pii.joined(base).split(","))) <= set(spans) and len(spans) == r["n_spans"]
            for m in re.finditer(r"[0-9a-f]{40}", text or ""):
                assert f"secret:{m.start()}:{m.end()}" in spans


def test_redaction(odd, empty):
    out = {(r["doc_id"], r["source"]): r for r in pii.redact(odd).collect()}
    assert out[10, "pii"]["text"] == "mail [EMAIL] or [PHONE] or [IP] today"
    assert out[10, "pii"]["n_chars"] == len(out[10, "pii"]["text"]) and out[1, "x"]["text"] is None and out[4, None]["text"] == BASE
    assert pii.find(empty).count() == 0


def test_quality(spark, docs, odd, empty):
    junk = [(i, "GO!! NOW!! BUY!! THIS!! THING!! AT!! ONCE!! FRIEND!! " * 5, 0) for i in range(20)] + [(100 + i, " | ".join(f"cell{j}" for j in range(60)), 0) for i in range(20)]
    bad = [(200 + i, f"you are an idiot and a stupid moron said person{i} to the other one in the street", 0) for i in range(20)]
    good = [(300 + i, f"the road from town {i} to the coast runs along a river, and people walk there in the evening when it is cool.", 1) for i in range(140)]
    df = spark.createDataFrame(junk + bad + good, "doc_id long, text string, want int")
    for r in quality.classify(df).collect():
        assert r["keep"] == bool(r["want"]), r["text"]
    out = quality.classify(odd)
    assert out.count() == len(ODD) and out.filter("text is null or text = ''").filter("keep").count() == 2
    assert quality.classify(empty).count() == 0


def test_rare_toxic_documents(spark):
    """Eight toxic documents among 10,000: all go, clean ones stay."""
    rng = random.Random(5)
    some = [f"{a}{b}" for a in ("ro", "ta", "mi", "lu", "sen", "gar") for b in ("den", "vel", "ka", "st", "nor", "li", "pe")]
    rows = [(i, " ".join(rng.choice(some) for _ in range(40)) + (" you stupid idiot and worthless scum" if i % 1250 == 7 else "")) for i in range(10_000)]
    kept = {r["doc_id"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).filter("keep").collect()}
    assert not any(i % 1250 == 7 for i in kept) and len(kept) > 9_950


def test_quality_on_held_out_labels(spark):
    """Fitted with three quarters of the labels: toxic and junk documents of the rest go, clean ones stay."""
    folder = "/root/testdata/sf0.1"
    every = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").repartition(8)
    model = quality.fit(docs, every.filter("doc_id % 4 < 3"))
    got = quality.score(docs, model).join(every.filter("doc_id % 4 = 3"), "doc_id").selectExpr("quality", "toxic", "double(keep) as kept")
    share = {(r["quality"], r["toxic"]): r["avg(kept)"] for r in got.groupBy("quality", "toxic").avg("kept").collect()}
    assert share[1, 0] > 0.94 and share[1, 1] < 0.06 and share[0, 0] < 0.06 and share[0, 1] < 0.06


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    acc = [0.95, 0.85, 0.9]
    v = np.array([[int(t if rng.random() < a else not t) for a in acc] for t in truth])
    own = collections.Counter(map(tuple, v.tolist()))
    share, table = quality.estimate(sorted(own.items()))
    assert abs(share - 0.2) < 0.04 and all(abs(table[k, 1, 2] - acc[k]) < 0.06 for k in range(3))


def brute_top(vectors, k, exact=False):
    out = {}
    for q, x in vectors:
        if q % 20 == 0:
            s = sorted(((-float(np.dot(x, y)), c) for c, y in vectors if c != q))
            out[q] = [(c, -v) for v, c in s[:k]]
    return out


def test_searches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:180] = x[40]
    rows = [(i, x[i].tolist()) for i in range(700)] + [(701, None), (702, [1.0, None]), (703, [float("nan")] * 16), (704, [0.0] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids = [(i, x[i].astype(np.float64)) for i in range(700)]
    v = topk.valid(df, "embedding", "vec_id", True)
    got = collections.defaultdict(list)
    for r in ann.ann_search(v.filter("id % 20 = 0"), v).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_top(ids, 20)
    same = sum(len({c for c, _ in got[q]} & {c for c, _ in w}) for q, w in want.items())
    assert same / sum(map(len, want.values())) > 0.95
    whole = [(i, np.floor(a * 64)) for i, a in ids] + [(704, np.zeros(16))]
    e = topk.valid(df, "embedding", "vec_id").selectExpr("id", "transform(v, x -> cast(floor(x * 64) as double)) as v")
    got = collections.defaultdict(list)
    for r in topk.taat_search(e.filter("id % 20 = 0"), e).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], float(r["score"])))
    assert got == brute_top(whole, 20)
    none = e.limit(0)
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])], "id long, v array<double>")
    out = ann.ann_search(twice.filter("id = 20"), twice).orderBy("score").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(20, 1, 1.0), (20, 1, 1.0), (20, 1, 2.0), (20, 1, 2.0)]
    assert topk.taat_search(none, none).count() == 0 and ann.ann_search(none, none).count() == 0


def test_ann_recall(spark):
    """4,000 different vectors and short lists of 5 %: the quantiser decides, and a common vector doesn't fill the lists."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[500:900] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = collections.defaultdict(list)
    for r in ann.ann_search(df.filter("id % 200 = 0"), df, short=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12
    hit = 0
    for q in range(0, 4000, 200):
        s = x @ x[q]
        s[q] = -9
        hit += len(set(got[q]) & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
    assert sorted(got) == list(range(0, 4000, 200)) and hit / 400 > 0.9


def test_ann_lists_do_not_grow_with_groups(spark):
    """Queries give their short list once, also where many groups of codes meet them, and rows of one id once each."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(7)
    q = df.filter("id % 100 = 0")
    books = ann.fit(x[:300], 4, 16, 1)
    c = ann.coded(df, books).select("id", "code", "scale")
    lists = collections.Counter(r["query_id"] for r in ann.short_lists(q, c, books, 50).collect())
    assert lists == {i: 50 for i in range(0, 9000, 100)}
    made = [r["query_id"] for r in ann.short_lists(q, c.unionByName(c), books, 9000 * 2).select("query_id", "id").distinct().collect()]
    assert collections.Counter(made) == {i: 9000 for i in range(0, 9000, 100)}
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [3.0, 5.0])], "id long, v array<double>")
    out = ann.ann_search(twice.filter("id = 20"), twice).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in out) == [(20, 1, 1.0), (20, 1, 2.0), (20, 1, 3.0), (20, 1, 5.0)]


def test_lines_closest_first(spark, monkeypatch):
    """Pairs beyond the first few of a set decide too, sets that match early leave the rest, and of one document the earlier line stays."""
    words = [f"w{k}" for k in range(24)]
    rows = [(i, " ".join(words[: 20 + i % 5] + [f"{'abc'[k]}{i * (k + 1) % 7}" for k in range(3)]) + ("\n" + " ".join(words[:22]) if i % 4 == 0 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for first in (1, 1000):
        monkeypatch.setattr(lines, "FIRST", first)
        assert {tuple(r) for r in lines.removed_lines(df).collect()} == brute_lines(rows)
    monkeypatch.setattr(lines, "FIRST", 1)
    docs = spark.createDataFrame([(1, "a b c d e f\na b c d e g\nx y z x1 y1 z1"), (2, "a b c d e f h")], "doc_id long, text string").repartition(1)
    held = {(r["doc_id"], r["line"]): r["set"] for r in lines.line_sets(docs, lines.rarity(docs), 0.8).collect()}
    sets = spark.createDataFrame([(k, p) for p, k in held.items()], "set long, first struct<doc_id: long, line: int>")
    place = {k: p for p, k in held.items()}
    pairs = [((2, 0), (1, 2), 0, False), ((2, 0), (1, 0), 5, False), ((1, 0), (1, 0), 0, True), ((1, 2), (1, 2), 0, True)]
    pairs = spark.createDataFrame([(held[b], held[a], d, one) for b, a, d, one in pairs], "b long, a long, d int, one boolean")
    assert {place[r["set"]] for r in lines.matched(docs, sets, pairs, 0.8).collect()} == {(2, 0)}


def test_lines_pairs(spark):
    """Every similar pair of sets meets once, the shorter prefix of the smaller set is enough, and rows are dealt out once for both sides."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(w for w in words[: rng.choice((10, 24, 40))] if rng.random() > 0.08) + f" x{rng.randrange(9)}"
    docs = spark.createDataFrame([(i, "\n".join(text() for _ in range(3))) for i in range(60)], "doc_id long, text string")
    with lines.scratch(spark):
        held = lines.stored(lines.line_sets(docs, lines.rarity(docs), 0.8), "lines")
        sets = held.groupBy("set").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("f"), *(F.first(c).alias(c) for c in ("n", "skip", "least", "p0", "p1", "prefix")))
        sets = lines.stored(sets, "sets")
        place = {r["set"]: tuple(r["first"]) for r in sets.collect()}
        texts = {(r["doc_id"], k): frozenset(x.split()) for r in docs.collect() for k, x in enumerate(r["text"].split("\n"))}
        tokens = {k: texts[p] for k, p in place.items()}
        alike = lambda a, b: len(tokens[a] & tokens[b]) >= 0.8 * len(tokens[a] | tokens[b]) - 1e-9
        done = {k for i, k in enumerate(sorted(place)) if i % 9 == 0}
        want = {(b, a) for b in place for a in place if b not in done and place[a] < place[b] and alike(a, b)}
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            pairs = lines.token_pairs(sets, spark.createDataFrame([(k, True) for k in done], "set long, done boolean"), 0.8)
            rows = pairs.collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = [(r["b"], r["a"]) for r in rows]
        assert len(want) > 200 and want <= set(got) and len(got) == len(set(got))
        assert all(b not in done and place[a][0] <= place[b][0] and r["one"] == (place[a][0] == place[b][0]) for (b, a), r in zip(got, rows, strict=True))
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan and plan.count("SPARK_PARTITION_ID") == 1
        hubs = {tuple(r) for r in lines.hub_pairs(sets, 0.8).collect()}
        several = collections.Counter(b for b, _ in hubs)
        assert max(several.values()) > 1 and all(place[a] < place[b] for b, a in hubs)


def test_near_filter(spark):
    """All classes with ties pass the table of bits and few others do, without an exchange of the rows themselves."""
    rng = np.random.default_rng(4)
    cids = rng.integers(-(2**63), 2**63 - 1, 3000).tolist()
    rows = spark.createDataFrame([(c, b"x") for c in cids], "cid long, shingles binary")
    part = spark.createDataFrame([(c,) for c in cids[:200]], "cid long")
    out = near.candidates(rows, part)
    got = [r["cid"] for r in out.collect()]
    assert set(cids[:200]) <= set(got) and len(got) < 210 and out.columns == rows.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert near.candidates(rows, part.limit(0)).count() == 0


def test_packing_words(spark):
    """Null characters are text as any other, wherever they are; a worker keeps no words beyond its task."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a \0b", "\0", "\0 \0\0x,\n\0y", "x.\n\nY", "é,\nß.\nfoo!!", " a\nb,", "12,\n3 a,b", "\n", " \n", "a\r\nb c\u00a0\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in packing.pack(df).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))

    def kept(batches):
        from meridion.llm import packing

        for b in batches:
            yield b.slice(0, 1).set_column(0, "doc_id", pa.array([sum(len(c.words) for c in packing._CACHE.values())], pa.int64()))

    assert all(r["doc_id"] == 0 for r in df.select("doc_id").mapInArrow(kept, "doc_id long").collect())


def test_licences(odd, empty):
    text = "Head.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. More. Released under the MIT License."
    df = odd.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert list(r["rules"]) == ["apache-short-text", "mit-released"] and list(r["licenses"]) == ["Apache-2.0", "MIT"]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


def notice(ids, width, mark, gap):
    """The sentences of a rule, wrapped at a width, with a comment or list mark on each line."""
    paragraphs = [textwrap.wrap(licenses.SENTENCES[i].capitalize() + ("." if k % 2 else ":"), width) for k, i in enumerate(ids.split())]
    return gap.join("\n".join(mark + line for line in p) for p in paragraphs)


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices(spark, width):
    rows = [(f"{r}/{mark}/{gap!r}", f"A Title\n\n{notice(ids, width, mark, gap)}\n\nother words\n") for r, _, _, ids in licenses.RULES for mark in ("", " * ", "# ", "//  ") for gap in ("\n", "\n" + mark.rstrip() + "\n", "\r\n\r\n")]
    got = {r["id"]: (list(r["rules"]), r["sentence_ids"]) for r in licenses.scan(spark.createDataFrame(rows, "id string, text string")).collect()}
    want = {r: ids.split() for r, _, _, ids in licenses.RULES}
    assert all(rules == [i.split("/")[0]] and ids == want[i.split("/")[0]] for i, (rules, ids) in got.items())


def test_wrapped_bsd_notice(spark):
    text = """/*
 * Copyright (c) 2020, Some One
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * (b) Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 */"""
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["sentence_ids"] == ["all-rights", "bsd-grant", "bsd-source", "bsd-binary"] and "bsd2-text" in r["rules"]


def test_pipeline(spark, odd, empty):
    for df in (odd, empty):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, FOLDER)
            assert df.columns == odd.columns and df.count() <= n, name
        got = corpus_pipeline.STAGES[-1][1](spark, df, FOLDER)
        assert math.isclose(sum(r["length"] for r in got.collect()) > 0, n > 0)


def test_pipeline_keeps_clean_documents(spark):
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) > 0.85 * len(clean)


def test_pipeline_equals_brute_force(spark):
    """Every stage on what the one before kept: documents rejected, lines removed, one document of each group, spans replaced, all ids packed."""
    import pickle

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    weights = {t: dict(zip(model[t]["at"].tolist(), model[t]["weight"].tolist(), strict=True)) for t in quality.SCORERS}
    reader, want = quality.Reader(model["mined"]), {}
    for i, text in rows(docs).items():
        found = reader.features(text) if text else set()
        if not text or all(sum(weights[t].get(x, 0.0) for x in found) + model[t]["bias"] < 0 for t in quality.SCORERS):
            want[i] = text
    df = stage["quality"](spark, docs, FOLDER).persist()
    assert rows(df) == want

    gone = brute_lines(list(want.items()))
    want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in want.items()}
    df = stage["line_dedup"](spark, df, FOLDER).persist()
    assert rows(df) == want

    group = {i: g for i, (_, _, g) in brute_near(list(want.items())).items()}
    want = {i: t for i, t in want.items() if group[i] == i}
    df = stage["near_duplicates"](spark, df, FOLDER).persist()
    assert rows(df) == want

    tagged = pii.Reader(pickle.loads(pii.trained()))
    for i, text in want.items():
        for s, k, e in reversed(pii.all_spans(text or "", naive(text or ""), tagged.tag([text or ""])[0])):
            text = f"{text[:s]}[{pii.KINDS[k].upper()}]{text[e:]}"
        want[i] = text
    df = stage["personal_data"](spark, df, FOLDER).persist()
    assert rows(df) == want

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = collections.defaultdict(list)
    for r in stage["packing"](spark, df, FOLDER).collect():
        got[r["doc_id"]].append(r)
    assert got.keys() == want.keys()
    for i, text in want.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
