"""Vector operators, archives and the pipeline against plain versions."""

import gzip
import hashlib

import numpy as np
import pytest

from pairwise.llm import components, neighbours, vectors, warc
from pairwise.session import scratch_path

VECTORS = "vec_id long, embedding array<float>, label int, unit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], VECTORS)


def random_rows(seed, n, dims=24, labels=3, copies=40):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dims)) + 0.3
    for _ in range(copies):
        i, j = draw.integers(0, n, 2)
        base[i] = base[j] + draw.standard_normal(dims) * draw.choice([0.0, 0.05, 0.25])
    return [(i, [float(np.float32(x)) for x in row], int(draw.integers(0, labels))) for i, row in enumerate(base)]


ODD = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [1.0, 2.0], 1),
       (905, [], 2), (906, [float("inf")] + [1.0] * 23, 0)]


def test_neighbours_against_brute_force(spark):
    rows = random_rows(1, 400)
    rows += [(500, rows[100][1], 0), (600, rows[100][1], 0)]
    found = neighbours.nearest(table(spark, rows + ODD), table(spark, rows + ODD).where("vec_id % 100 = 0")).collect()
    ids = np.array([r[0] for r in rows])
    data = np.array([r[1] for r in rows])
    hits = total = 0
    for query in ids[ids % 100 == 0]:
        gap = np.sqrt(((data - data[ids == query][0]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, gap)) if ids[k] != query][:10]
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        hits += len({r.vec_id for r in own} & set(ids[order]))
        total += 10
        for r in own:
            assert r.score == gap[ids == r.vec_id][0]
    assert hits / total >= 0.99
    assert {r.query_id for r in found} == set(ids[ids % 100 == 0])


def test_neighbours_edges(spark):
    empty = table(spark, [])
    assert neighbours.nearest(empty, empty).count() == 0
    few = table(spark, [(0, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 1.0, 1.0], 1), (None, [1.0, 0.0], 1)])
    rows = neighbours.nearest(few, few.where("vec_id = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 7)]


def test_error_bounds_hold():
    draw = np.random.default_rng(4)
    rows, turn = draw.standard_normal((3000, 64)), neighbours.rotation(64)
    codes, norms, fit = neighbours.encode(rows, turn)
    query = draw.standard_normal(64)
    query /= np.linalg.norm(query)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    found, error = neighbours.estimate(codes, ones, fit, turn @ query)
    exact = (rows @ query) / norms
    assert (np.abs(found - exact) <= error).mean() > 0.995


@pytest.mark.parametrize("small", [64, 3, 0])
def test_links_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)     # so that buckets are cut into blocks
    monkeypatch.setattr(vectors, "SMALL", small)
    rows = random_rows(2, 300, copies=200)
    rows += [(700 + k, rows[5][1], rows[5][2]) for k in range(20)] + [(800, rows[5][1], None)]
    got = {r.vec_id: r for r in vectors.near_equal(table(spark, rows + ODD)).collect()}
    data = np.array([r[1] for r in rows], dtype=float)
    data /= np.linalg.norm(data, axis=1)[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    ids = np.array([r[0] for r in rows])
    linked = (data @ data.T >= 0.93) & (label[:, None] == label) & (label >= 0)[:, None]
    np.fill_diagonal(linked, False)
    roots = ids.copy()
    while True:
        low = np.minimum(roots, np.where(linked, roots[None, :], 10**9).min(axis=1))
        if (low == roots).all():
            break
        roots = low
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (linked[k].sum(), roots[k]), i
        assert got[i].kept == (roots[k] == i)
    assert all((got[r[0]].n_links, got[r[0]].component_id) == (0, r[0]) for r in ODD)
    assert vectors.near_equal(table(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (30, 129)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 0 for i in range(30)}}


# ------------------------------------------------------------------ archives
PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark):
    big = "é" * 70_000
    pages = spark.createDataFrame([
        (3, "http://a/\r\nX: y", "<p>" + "b" * 200, "extra"), (1, None, "<p>" + "b" * 200, "extra"), (2, "http://b", "tiny", "extra"),
        (4, "http://c", "tiny", "extra"), (5, "http://d", None, "extra"), (6, "", big, "extra"), (None, "http://e", big, "extra"),
    ], PAGES)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, chunk=1000)
    rows = {r.page_id: r for r in warc.read_records(spark, manifest).collect()}
    text = {3: "<p>" + "b" * 200, 1: "<p>" + "b" * 200, 2: "tiny", 4: "tiny", 5: "", 6: big, None: big}
    kinds = {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("response", None),
             6: ("response", None), None: ("revisit", 6)}
    for page, html in text.items():
        raw, row = html.encode(), rows[page]
        assert (row.payload_bytes, row.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (row.record_type, row.refers_to) == kinds[page] and row.intact
    chunks = [c for c in warc.read_chunks(spark, manifest, chunk=512).collect() if c.record_type == "response"]
    for page in (1, 2, 5, 6):
        own = sorted((c for c in chunks if c.page_id == page), key=lambda c: c.chunk_no)
        assert b"".join(bytes(c.data) for c in own) == text[page].encode()
        assert own[-1].digest_so_far == rows[page].payload_digest and max(len(c.data) for c in own) <= 512
    path = manifest.first().path.removeprefix("file:")
    with gzip.open(path) as stream:
        assert stream.read(8) == b"WARC/1.1"


def test_large_records_and_rolling_files(spark):
    """Payloads above the default chunk, and files that end after a few records."""
    html = {i: f"{i} " + "é<p>" * n for i, n in enumerate([900_000, 10, 300_000, 0, 500_000, 20])}
    pages = spark.createDataFrame([(i, "u", t, "e") for i, t in html.items()], PAGES).repartition(1)
    manifest = warc.write_archives(pages, scratch_path(spark, "warc-rolled"), roll_at=2000)
    assert manifest.select("path").distinct().count() > 1
    rows = {r.page_id: r for r in warc.read_records(spark, manifest).collect()}
    for i, text in html.items():
        raw = text.encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest()) and rows[i].intact
    counts = {r.page_id: r["count"] for r in warc.read_chunks(spark, manifest, with_data=False).groupBy("page_id").count().collect()}
    assert counts == {i: max(1, -(-len(t.encode()) // warc.CHUNK)) for i, t in html.items()}


def test_archive_edges(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.round_trip(spark, empty).count() == 0
    twice = spark.createDataFrame([(1, "u", "c" * 100, "e")] * 2 + [(2, "u", "c" * 100, "e")], PAGES)
    rows = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, twice).collect())
    assert rows == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_a_torn_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "d" * 5000, "e")], PAGES)
    manifest = warc.write_archives(pages, scratch_path(spark, "warc-torn"))
    data = open(manifest.first().path.removeprefix("file:"), "rb").read()
    torn = tmp_path / "torn.warc.gz"
    torn.write_bytes(data[:-20])
    with pytest.raises(ValueError):
        for _, pieces in warc.records(str(torn)):
            list(pieces)


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "pack":
            assert after.columns == columns and 0 < after.count() <= before
            before = after.count()
            docs = after
    assert after.select("doc_id").distinct().count() == before
    assert pipeline.run(spark, folder).count() == after.count()


# ------------------------------------------------------------------ rows that share an id
def test_rows_of_one_id_keep_their_own_links(spark):
    a, b, c, d = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.1, 0.0]
    rows = [(1, a, 7), (1, c, 7), (2, b, 7), (3, d, 7), (4, c, 7)]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_equal(table(spark, rows)).collect())
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_first_shared_bucket_is_that_of_the_definition():
    draw = np.random.default_rng(3)
    tables = 6
    make = lambda n: np.arange(tables).repeat(vectors.PROBES) * 100 + draw.integers(0, 5, (n, tables * vectors.PROBES))
    left, right = make(300), make(300)
    met = np.array([bool(set(x) & set(y)) for x, y in zip(left, right, strict=True)])
    left, right = left[met], right[met]
    wanted = [next(k for k in x if k in set(y)) for x, y in zip(left.tolist(), right.tolist(), strict=True)]
    assert vectors._first_shared(left, right).tolist() == wanted


def test_a_threshold_that_cannot_be_met_is_an_error():
    with pytest.raises(ValueError):
        vectors.table_count(64, -0.9, 6)
