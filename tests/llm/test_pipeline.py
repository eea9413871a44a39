import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from pitrank.llm import decontaminate as D, mixing, queries, shards

from conftest import SF
from test_decontaminate import distance
from test_simhash import classes, plain_fingerprint
from texts import prose, table

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for i in range(240):
        words = prose(80 + i % 50, i).split()
        if i % 5 == 0:
            words[::9] = ["crook"] * len(words[::9])
        rows.append((i, " ".join(words), "en", f"src{i % 4}"))
    rows += [(300, rows[1][1], "en", "src1"), (301, rows[1][1] + " ", "en", None), (302, prose(60, 900) + " " + prose(40, 77),
                                                                                   "en", "src2")]
    rows += [(303, None, None, None), (304, "", "en", "src0"), (None, prose(70, 55), None, "src1"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 1, "kept") for r in rows], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 240)], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(40, 77)), (2, None)], "item_id bigint, text string") \
        .write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = C.drop_toxic(spark, docs, folder)
    assert clean.columns == columns
    gone = {i for i, *_ in table(docs)} - {i for i, *_ in table(clean)}
    assert gone == {i for i in range(0, 240, 5)}

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    unique = C.drop_near_duplicates(spark, clean, folder)
    texts = {r[0]: r[1] for r in table(clean) if r[0] is not None}
    root = classes({i: plain_fingerprint(t) for i, t in texts.items()})
    assert sorted(i for i, *_ in table(unique) if i is not None) == sorted(i for i in root if root[i] == i)
    assert unique.columns == columns and unique.where("doc_id IS NULL").count() == 1
    assert unique.where("doc_id IN (300, 301)").count() == 0 and unique.where("doc_id = 3").count() == 1

    unique = spark.createDataFrame(unique.collect(), docs.schema)
    safe = C.drop_leaks(spark, unique, folder)
    item = D.normalize(prose(40, 77))
    want = [r for r in table(unique) if distance(item, D.normalize(r[1] or "")) > len(item) // 20]
    assert table(safe) == want and safe.columns == columns and len(want) < unique.count()

    safe = spark.createDataFrame(safe.collect(), docs.schema)
    mixed = C.mix_sources(spark, safe, folder)
    plan = {r[0]: r[5] for r in table(mixing.mixture(queries.as_filings(safe)))}
    counts = dict(table(mixed.groupBy("doc_id").count()))
    assert counts == {i: n for i, n in plan.items() if n} and mixed.columns == columns

    placed = C.shard(spark, mixed, folder)
    assert placed.count() == mixed.count()
    size = shards.prime_from(128 * len(queries.SHARDS))
    slots = shards.fill_table(queries.SHARDS, size)
    for i, slot, shard in placed.select("doc_id", "slot", "shard").collect():
        assert slot == shards.key_number("" if i is None else str(i)) % size and shard == queries.SHARDS[slots[slot]]


def test_run_and_empty_tables(spark, folder, tmp_path):
    got = C.run(spark, folder)
    again = C.run(spark, folder)
    assert table(got) == table(again) and got.count() > 100
    path = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    assert C.run(spark, path).count() == 0


def test_every_query_runs_on_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{path}/embeddings.parquet")
    for name, fn in queries.QUERIES.items():
        assert fn(spark, path).count() == 0, name


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination", "mixing", "sharding"])
def test_columns_of_any_name_pass_through(spark, folder, stage):
    names = ["_size", "_key", "_pattern", "_plan", "_copy", "_together", "_slot", "_b", "_id", "_body", "document", "filing_id",
             "exchanges", "row", "text_", "at"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("slot").limit(60)  # slot is what sharding adds
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    run = dict(C.STAGES)[stage]
    got = run(spark, wide, folder)
    assert got.columns[:len(wide.columns)] == wide.columns
    for r in got.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
    plain = run(spark, docs, folder)
    assert table(got.select(plain.columns)) == table(plain)


def test_labels_of_held_out_rows_are_not_read(spark, folder):
    ids = [r[0] for r in spark.range(500).where(queries.held_out(F.col("id"), 5, 0)).collect()]
    assert ids == [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
