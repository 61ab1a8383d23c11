"""Source divergence, hard negatives and archives: against their SQL on odd fixtures, and their parts by themselves."""

import io
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from pathlens.llm import divergence, negatives, oracles, queries, warc  # noqa: E402


def by_sql(tmp_path, table, df, sql):
    import duckdb

    path = f"{tmp_path}/{table}.parquet"
    df.write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    return rows_of(connection.execute(sql).fetchall())


def rows_of(rows):
    return sorted(map(tuple, rows), key=repr)


# source divergence

def make_sources():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéÄ") for _ in range(rng.randint(1, 4))) for _ in range(70)] + ["x" * 300, "x" * 299 + "y"]
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "", "c"])
        mine = vocabulary[:40] if source == "a" else vocabulary
        words = [rng.choice(mine).swapcase() if rng.random() < 0.2 else rng.choice(mine) for _ in range(rng.randint(5, 40))]
        rows.append((i % 700, rng.choice([" ", "1", "-\x00", "\n"]).join(words), lang, source, 7, "x", "y", 3))
    rows += [(1, None, "en", "d", 0, "x", "y", 3), (None, "", "fr", "d", 0, "x", "y", 3), (2, "one lang alone", "de", "s", 0, "x", "y", 3), (2, "two", "it", "s", 0, "x", "y", 3), (2, "", "it", "t", 0, "x", "y", 3)]
    return rows


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(make_sources(), "doc_id long, text string, lang string, source string, n_chars long, digest string, item string, value long").repartition(3).cache()


@pytest.mark.parametrize("bits", [64, 5])
def test_divergence_equals_sql_also_where_digests_collide(sources, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(divergence, "DENSE", 20)
    got = divergence.source_divergence(sources, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got.collect()) == by_sql(tmp_path, "documents", sources, oracles.DIVERGENCE)


def test_divergence_of_nothing(sources):
    assert divergence.source_divergence(sources.limit(0)).collect() == []


def test_collided_digests_show_in_their_strings():
    texts = pa.record_batch({"text": pa.array(["a bb ccc a", None, "bb dd " + "e" * 500])})

    class Everything:
        value = np.full(1 << 17, 255, np.uint8)

    found = [row for batch in divergence._extremes(iter([texts]), 1, Everything, (1 << 20) - 1) for row in batch.to_pylist()]
    exact = [row for batch in divergence._extremes(iter([texts]), 64, Everything, (1 << 20) - 1) for row in batch.to_pylist()]
    assert {r["low"] for r in exact} == {"a", "bb", "ccc", "dd", "e" * 500} and all(r["low"] == r["high"] for r in exact)
    assert len(found) == 2 and min(r["low"] for r in found) == "a" and max(r["high"] for r in found) == "e" * 500


# hard negatives

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(700):
        v = centres[rng.integers(4)] + 0.4 * rng.normal(size=8)
        rows.append((i, (v / np.linalg.norm(v)).round(2).tolist(), int(rng.integers(5)), "x", "y"))
    rows += [(800, None, 1, "x", "y"), (900, [float("nan")] * 8, 1, "x", "y"), (1000, [float("inf")] + [0.0] * 7, 1, "x", "y"), (1100, [1.0] * 8, None, "x", "y"), (1200, [0.0] * 8, 2, "x", "y"), (1300, [0.5, None] * 4, 2, "x", "y")]
    rows += [(1301 + i, rows[0][1], i % 3, "x", "y") for i in range(30)] + [(1400, [1.0, 2.0], 3, "x", "y"), (1401, [1.0, 1.5], 3, "x", "y"), (1402, [1.0, 1.4], 4, "x", "y"), (1403, [], 4, "x", "y"), (None, rows[0][1], 4, "x", "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string, score string").repartition(3).cache()


@pytest.mark.parametrize(("block", "tree"), [(12, 9), (4, 1)])
def test_negatives_equal_sql(spark, vectors, tmp_path, monkeypatch, block, tree):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "TREE", tree)
    vectors.write.parquet(f"{tmp_path}/of/embeddings.parquet")
    got = queries.op12_hard_negatives(spark, f"{tmp_path}/of")
    wanted = by_sql(tmp_path, "embeddings", vectors, oracles.HARD_NEGATIVES)
    assert len(wanted) > 150 and rows_of(got.collect()) == wanted


def test_negatives_of_nothing_and_of_repeated_rows(spark, vectors):
    assert negatives.hard_negatives(vectors.limit(0)).collect() == []
    rows = [(100, [1.0, 0.0], "a"), (100, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [1e300, 1.0], "b"), (3, [3e18, 1.0], "b")]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert rows_of(got.collect()) == [(100, 100, 1, 1, 65536, 65536)] * 2


def test_large_scores_are_exact(spark):
    big = float(1 << 20)
    rows = [(100, [big, 1.0], 0), (1, [big, 1.0], 0), (2, [big, 0.99609375], 1), (3, [big, 1.00390625], 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert rows_of(got.collect()) == [(100, 1, 1, 2, (1 << 56) + 65536, (1 << 56) + 65280)]


def test_the_tree_spares_scores_and_loses_none():
    rng = np.random.default_rng(1)
    centres = np.floor(256 * rng.normal(size=(6, 16))).astype(np.int64)
    anchors = (centres[:, None] + rng.integers(-12, 13, (6, 30, 16))).reshape(-1, 16)
    candidates = (centres[:, None] + rng.integers(-12, 13, (6, 200, 16))).reshape(-1, 16)
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(180)) and (parent[1:] < np.arange(1, 180)).all()
    anchors, truth = anchors[order], anchors[order] @ candidates.T
    scores, done, missing = negatives.Scores(anchors, candidates), [0], [0]

    def window(a, warm):
        return truth[a].max() * 0.9, truth[a].max(), np.ones(len(candidates), bool)

    def computed(a, which, values):
        done[0] += len(which)
        assert (values == truth[a][which]).all()
        missing[0] += len(set(np.flatnonzero(truth[a] >= 0.9 * truth[a].max()).tolist()) - set(which.tolist()))
        return which[:0]

    scores.walk(parent, edge, np.zeros(0, np.int64), window, computed)
    assert missing[0] == 0 and done[0] < 0.4 * truth.size


# archives

@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://a.b/{i}", f"<html><p>{' '.join(rng.choice(['one', 'two', 'é', 'three']) for _ in range(60))}</p></html>" * 4) for i in range(60)]
    rows += [(100 + i, None, "the same") for i in range(40)] + [(200, "u\r\nX: y", rows[3][2]), (201, "é \x01", ""), (202, "", None), (203, "u", "z" * 3_000_000), (204, "u", "WARC/1.1\r\n\r\n"), (2, "u", "a copy?")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, row string, key string").repartition(3).cache()


def test_archives_equal_sql_and_are_read_at_any_place(spark, pages, tmp_path):
    wanted = by_sql(tmp_path, "pages", pages.filter("html <> 'a copy?' or html is null"), oracles.ARCHIVES)
    index = warc.write_archives(pages, f"file://{tmp_path}/archives").collect()
    got = warc.read_archives(spark, sorted({r.archive for r in index})).drop("row")
    assert rows_of(got.filter("payload_bytes <> 7").collect()) == wanted
    texts = {}
    for r in pages.collect():
        texts.setdefault(r.page_id, []).append((r.html or "").encode())
    for r in index:
        head, message, payload = warc.read_record(r.archive, r.offset, r.length)
        page = warc.page_of(head["warc-record-id"].strip("<>"))
        assert head["warc-type"] == "revisit" and not payload or payload in texts[page]
        assert "x" not in head and int(message["content-length"]) in map(len, texts[page])


def test_archives_begin_with_their_dictionary(spark, pages, tmp_path):
    index = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/archives")
    (archive,) = {r.archive for r in index.collect()}
    with open(archive.removeprefix("file://"), "rb") as file:
        magic, size = struct.unpack("<II", file.read(8))
        assert magic == 0x184D2A5D and file.read(4) == b"\x37\xa4\x30\xec" and index.agg(F.min("offset")).first()[0] == 8 + size


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, None), (5, ""), (6, "x")]
    got = warc.archive_report(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string"))
    assert rows_of(got.select("page_id", "record_type", "refers_to").collect()) == rows_of([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "revisit", 5), (5, "response", None), (6, "revisit", 1)])


def test_small_payloads_may_all_be_responses_and_nothing_writes_nothing(pages):
    got = warc.archive_report(pages, least_bytes=100)
    assert got.filter("record_type = 'revisit'").select("page_id", "refers_to").collect() == [(200, 3)]
    assert warc.archive_report(pages.limit(0)).collect() == []


def test_records_that_were_changed_are_not_read():
    data = warc.record(1, 1, "u", b"payload", None, "d")
    assert next(warc.records(io.BytesIO(data)))[2] == b"payload"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[1:])))
