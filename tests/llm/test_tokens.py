import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitrank.functions.lineage import new_path
from pitrank.llm import edit_counts as E, token_orc as O
from pitrank.llm.tokens import encoder

from texts import filings, odd_rows, prose, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = "a  b\n c  d  e\x1c f \n\n  g's don't 12 3.4 é😀 <|endoftext|> \t x"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def random_text(r: random.Random, n: int) -> str:
    return "".join(r.choice(["a", "B", "é", "1", " ", " ", "  ", "\n", ".", "'s", "the ", " ", "\x1c", "😀", "中", "<|endoftext|>"])
                   for _ in range(n))


def test_units_join_to_whole_text_encoding(plain):
    r = random.Random(1)
    texts = [ODD, "", " ", "x", " x"] + [random_text(r, r.randint(0, 60)) for _ in range(500)]
    ids, bounds = encoder(VOCABULARY).encode(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == plain(text), repr(text)
    assert encoder(VOCABULARY).encode([])[1].tolist() == [0]


def test_token_files_round_trip(spark, plain):
    rows = odd_rows() + [(9, ODD)]
    path = new_path(spark, "test")
    O.write_token_files(filings(spark, rows), path, VOCABULARY)
    files = O.read_token_files(spark, path)
    got = O.token_starts(files, files)
    got = [r.asDict() for r in got.orderBy(F.col("filing_id").asc_nulls_first(), "start").collect()]
    digests = O.token_starts(O.token_digests(files), files).orderBy(F.col("filing_id").asc_nulls_first(), "start").collect()
    start = 0
    for (doc, text, *_), r, q in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), got, digests, strict=True):
        ids = plain(text or "") + [2]
        assert (r["filing_id"], r["ids"], r["n_tokens"], r["start"]) == (doc, ids, len(ids), start)
        assert (q["filing_id"], q["start"]) == (doc, start)
        assert q["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = O.read_token_files(spark, path, [4, 77])
    assert [r[0] for r in one.select("filing_id").collect()] == [4]
    assert "PushedFilters: [In(filing_id" in one._jdf.queryExecution().toString()
    empty = new_path(spark, "test")
    O.write_token_files(filings(spark, []), empty, VOCABULARY)
    none = O.read_token_files(spark, empty)
    assert O.token_starts(O.token_digests(none), none).count() == 0


def test_edits_keep_counts_right(plain):
    r = random.Random(2)
    for k in range(40):
        text = random_text(r, r.choice([0, 5, 400, 3000]))
        tree = E.build_trees([text], VOCABULARY)[0]
        assert (tree.tokens, tree.chars) == (len(plain(text)), len(text))
        for _ in range(12):
            a = r.randint(0, len(text) + 2)
            b = a + r.choice([0, 1, 7, 300, 5000])
            new = random_text(r, r.choice([0, 0, 1, 9, 1500]))
            want = text[:min(a, len(text))] + new + text[min(b, len(text)):]
            text, tree, again = E.apply_edit(text, tree, a, b, new, VOCABULARY)
            assert text == want
            assert (tree.tokens, tree.chars) == (len(plain(text)), len(text))
            assert again <= len(text)


def test_small_edits_touch_little():
    text = prose(20_000, 4)
    tree = E.build_trees([text], VOCABULARY)[0]
    _, _, again = E.apply_edit(text, tree, 60_000, 60_003, "x", VOCABULARY)
    assert again < 4 * E.LEAF_CHARS


def test_stored_trees_and_edits_of_odd_rows(spark, plain):
    text = "Call 555 123 4567\nsame line\nother\nsame line\nend 1234567890"
    kept = odd_rows() + [(9, text)]
    df = filings(spark, kept).withColumn("edits", E.redactions("document")).withColumn("tree", E.token_trees("document", VOCABULARY))
    path = new_path(spark, "trees")
    df.write.parquet(path)  # trees are kept next to the texts and used later
    stored = spark.read.parquet(path)
    got = {r["filing_id"]: r for r in stored.select("filing_id", "tree", "document", "edits", E.edited("document", "tree", "edits", VOCABULARY).alias("e"))
           .select("filing_id", "tree", "document", "edits", F.col("e.tree").alias("after"), "e.n_tokens_before", "e.n_tokens",
                   "e.n_edits", "e.n_chars", "e.n_chars_reencoded").collect()}
    assert len(got) == len({x[0] for x in kept})
    for doc, body, *_ in kept:
        assert sum(got[doc]["tree"]["leaf_tokens"]) == len(plain(body or ""))
        assert sum(got[doc]["tree"]["leaf_chars"]) == len(body or "")
        text_after = E.edited_text(body, [e.asDict() for e in got[doc]["edits"]])
        assert sum(got[doc]["after"]["leaf_tokens"]) == got[doc]["n_tokens"] == len(plain(text_after))
        assert got[doc]["n_tokens_before"] == len(plain(body or "")) and got[doc]["n_chars"] == len(text_after)
    after = "Call <number>\nsame line\nother\nend <number>"
    assert E.edited_text(text, [e.asDict() for e in got[9]["edits"]]) == after
    assert (got[9]["n_edits"], got[9]["n_tokens"]) == (3, len(plain(after)))
    none = filings(spark, [(1, "a b")]).withColumn("edits", F.lit(None).cast(E.EDITS)).withColumn("tree", F.lit(None).cast(E.TREE))
    assert table(none.select(E.edited("document", "tree", "edits", VOCABULARY)["n_tokens"])) == [(2,)]
    assert df.limit(0).select(E.edited("document", "tree", "edits", VOCABULARY)).count() == 0


def test_kept_trees_are_read_by_the_edits(spark, plain, monkeypatch):
    """The edit pass starts from the stored trees: it encodes nothing but touched regions."""
    docs = filings(spark, [r[:2] for r in odd_rows()] + [(50, "call 123 456 789 now\nsame line\nsame line\n" + prose(900, 3)),
                                                        (51, "x <|endoftext|> 12345678901 y")])
    kept = E.with_kept_trees(docs, VOCABULARY)
    assert kept.columns == ["filing_id", "document", "tree"] and len(kept.inputFiles()) > 0
    for r in kept.collect():
        assert sum(r["tree"]["leaf_tokens"]) == len(plain(r["document"] or "")), r["filing_id"]
    got = E.edited_filings(kept, E.redactions("document"), VOCABULARY).collect()
    assert len(got) == kept.count()
    by = {r["filing_id"]: r["edited"] for r in got if r["filing_id"] in (50, 51)}
    texts = {r["filing_id"]: r["document"] for r in kept.collect()}
    for i, e in by.items():
        changed = E.edited_text(texts[i], [{"start": a, "stop": b, "replacement": t} for a, b, t in E.redactions_of(texts[i])])
        assert e["n_tokens"] == len(plain(changed)) and e["n_edits"] > 0 and e["n_tokens_before"] == len(plain(texts[i]))
    assert by[50]["n_chars_reencoded"] < len(texts[50]) / 2
    assert E.edited_filings(E.with_kept_trees(docs.limit(0), VOCABULARY), E.redactions("document"), VOCABULARY).count() == 0
