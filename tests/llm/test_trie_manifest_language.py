"""The prefix trie, the Merkle manifest and language identification against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwise.llm import langid, merkle, numbering, queries, trie
from pairwise.session import via_table
from tests.parity import compare

TURNS = "conv_id long, turn long, role string, text string, pos long, a long, shard string"


# ------------------------------------------------------------------ trie
def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS)


def plain_trie(rows, h_of=None):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    built = own
    if h_of:
        built = {c: own.get(c - int(np.fmod(c, 5)), [])[:h_of(c)] + ts[h_of(c):] for c, ts in own.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
                    len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_trie(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def some_turns(seed, convs, longest, texts):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-10, 3 * convs), convs):
        for t in range(draw.randint(1, longest)):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", None, "bot"][:2]), draw.choice(texts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "shard"), [(256, 1 << 14), (3, 20)])
def test_trie_against_plain(spark, monkeypatch, block, shard):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    rows = some_turns(1, 60, 9, ["a", "ä", None, ""]) + [(None, 1, "user", "lost")]
    table = conversations(spark, rows)
    h_of = lambda c: zlib.crc32(str(c).encode()) % 9
    shared = F.crc32(F.col("conv_id").cast("string")) % 9
    built = trie.trie(trie.spliced(trie.ordered(table), 5, shared))
    assert found_trie(built) == plain_trie(rows, h_of)
    assert found_trie(trie.trie(trie.ordered(table))) == plain_trie(rows)


def test_trie_edges(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    assert trie.trie(trie.ordered(conversations(spark, []))).count() == 0
    same = [(7, 0, "user", "x")] * 4 + [(9, 0, "user", "x")] * 2        # equal rows are turns of their own
    assert found_trie(trie.trie(trie.ordered(conversations(spark, same)))) == plain_trie(same)
    long = [(c, t, "user", "y" * 3000 if t == 30 else "y") for c in (1, 2) for t in range(40)]
    assert found_trie(trie.trie(trie.ordered(conversations(spark, long)))) == plain_trie(long)
    ends = [(c, 0, "user", "z") for c in [*range(-3, 40), 1 << 20, 1 << 40, -(1 << 40)]]
    assert found_trie(trie.trie(trie.ordered(conversations(spark, ends)))) == plain_trie(ends)


def test_numbers_in_groups(spark):
    rows = spark.createDataFrame([(None if i % 3 else "g", i // 4, "k") for i in range(200)], "g string, v long, part string")
    got = via_table(numbering.numbered(rows, ["g"], ["v"], "no", "size"), "test-numbers").collect()
    for group in ("g", None):
        mine = sorted((r.no, r.v, r["size"]) for r in got if r.g == group)
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[2] for m in mine} == {len(mine)}
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)


# ------------------------------------------------------------------ manifest
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_climb(digests):
    """The root and, for every leaf, its (before, after) siblings level by level."""
    paths, owner = [[] for _ in digests], [[i] for i in range(len(digests))]
    level = list(digests)
    while len(level) > 1:
        up, up_owner = [], []
        for at in range(0, len(level), 16):
            run = level[at:at + 16]
            for i in range(len(run)):
                for leaf in owner[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1:])))
            up.append(sha("".join(run)))
            up_owner.append([x for o in owner[at:at + 16] for x in o])
        level, owner = up, up_owner
    return level[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        values = [r.doc_id, r.source, r.lang, r.n_chars, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        members = sorted(groups[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((members, *plain_climb([leaf(r, r.text) for r in members])))
    if not trees:
        return []
    root, upper = plain_climb([t[1] for t in trees])
    out = []
    for (members, top, paths), above in zip(trees, upper, strict=True):
        for r, path in zip(members, paths, strict=True):
            whole = path + above
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            own = leaf(r, text)
            for before, after in whole:
                own = sha(before + own + after)
            proof = sha("".join(b + a for b, a in whole))
            out.append((r.doc_id, leaf(r, r.text), top, root, proof, own, own == root))
    return sorted(out, key=repr)


def manifest_of(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    rows = queries.op12_slot_pivot_manifest(spark, "").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_against_plain(spark, documents, monkeypatch):
    draw = random.Random(2)
    sources = ["big"] * 300 + [draw.choice(["é", "z", "", None]) for _ in range(40)] + [f"s{i}" for i in range(30)]
    texts = [draw.choice(["A b", "plain", None, "", "É À", "x" * 5000 + "Q"]) for _ in sources]
    ids = [draw.choice([i, i, i, 5, None]) for i in range(len(sources))]
    docs = documents(texts + texts[:3], ids + ids[:3], sources + sources[:3])
    assert manifest_of(spark, monkeypatch, docs) == plain_manifest(docs.collect())


def test_manifest_edges(spark, documents, monkeypatch):
    assert manifest_of(spark, monkeypatch, documents([])) == []
    lone = documents(["T"], [None], [None])
    assert manifest_of(spark, monkeypatch, lone) == plain_manifest(lone.collect())
    repeated = documents(["same"] * 40, [3] * 40)
    assert manifest_of(spark, monkeypatch, repeated) == plain_manifest(repeated.collect())


# ------------------------------------------------------------------ language
def plain_phrases(text, learned):
    """Longest matches in the learned pieces, found by looking for substrings."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at:end + 1] in piece for piece in learned):
            end += 1
        count, at = count + 1, end
    return count


def texts_in(letters, seed, n, words=40):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(words))
            for _ in range(n)]


def test_language_against_plain(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANE", 50)
    monkeypatch.setattr(langid, "LANES", 7)
    corpus = {"aa": texts_in("abcde", 1, 12), "bb": texts_in("bcdfgé", 2, 12)}
    rows = [(i * 2 + (lang == "bb"), t, lang, "x") for lang, ts in corpus.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, piece string")
    bounds = {"docs": 8, "piece": 60, "pieces": 9}
    learned = {r.lang: [langid.plain(p.piece) for p in r.pieces] for r in langid.sample(table, **bounds).collect()}
    assert all(len(p) == 9 for p in learned.values())
    model = langid.fit(table, **bounds)
    asked = [*texts_in("abcdefgé", 3, 6), "ABC, Ébc! 12", "日本 abc", "b"]
    lanes = [langid.symbols_of(model, t) for t in asked]
    counts = langid.phrases(model, lanes)
    for i, text in enumerate(asked):
        for j, lang in enumerate(model.langs):
            assert counts[j, i] == plain_phrases(langid.plain(text), learned[lang]), (text, lang)
    told = spark.createDataFrame([(t,) for t in asked], "text string").select(
        "text", langid.identify(model, F.col("text")).alias("t")).collect()
    for r in told:
        whole = langid.plain(r.text)
        bits = {lang: sum(plain_phrases(whole[a:a + 50], learned[lang]) for a in range(0, len(whole), 50)) * b
                for lang, b in zip(model.langs, model.bits, strict=True)}
        assert bits[r.t.lang] == min(bits.values()) and 0 <= r.t.score <= 1


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, table string"
    none = langid.fit(spark.createDataFrame([(1, "12", "en", ""), (None, "a", "en", ""), (2, "b", None, "")], schema))
    assert none.langs == []
    asked = spark.createDataFrame([(None,), ("",), ("12 ..!",), ("word",)], "text string")
    assert {tuple(r.t) for r in asked.select(langid.identify(none, F.col("text")).alias("t")).collect()} == {("und", 0.0)}
    rows = [(1, "the cat", "en", ""), (1, "the cat", "en", ""), (2, "le chat", "fr", "")]
    model = langid.fit(spark.createDataFrame(rows, schema))
    told = asked.union(spark.createDataFrame([("THE CAT " * 50_000,), ("le",)], "text string")).select(
        F.length("text").alias("n"), langid.identify(model, F.col("text")).alias("t")).collect()
    answers = {r.n: r.t.lang for r in told}
    assert answers[None] == answers[0] == answers[6] == "und" and answers[400_000] == "en" and answers[2] == "fr"
    assert spark.createDataFrame([], "text string").select(langid.identify(model, F.col("text"))).count() == 0


def test_language_held_out(spark, folder):
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op13_cross_parsing(spark, folder).join(truth, "doc_id").toPandas()
    assert list(rows.columns)[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]).all()
    kept = rows[rows["held_out"]]
    assert (kept["lang_pred"] == kept["lang"]).mean() >= 0.97 and rows["score"].between(0, 1).all()


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_slot_pivot_manifest"])
def test_queries_equal_sql(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), queries.SQL[name], folder) == []
