"""Small tables of filing documents with the cases every operator must take: NULLs, empty, long, repeated, odd columns."""
from __future__ import annotations

import random

WORDS = ("revenue growth margin capex dividends filing quarter segment goodwill lease pension tax asset equity share note "
         "interest cash audit risk").split()
# columns that operators use inside: they must neither be read nor get in the way
CLASHING = "slot string, shard string, fingerprint string, size string, pattern string, key string, score string, cell string"
SCHEMA = f"filing_id bigint, document string, language string, exchanges array<string>, {CLASHING}"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def filings(spark, rows):
    """rows: (id, text) or (id, text, language) or (id, text, language, exchanges)."""
    full = []
    for r in rows:
        r = list(r) + [None] * (4 - len(r))
        full.append((*r, *["x"] * 8))
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = prose(30_000, 1)
    return [(1, prose(120, 2), "en", ["NYSE"]), (1, prose(120, 2), "en", ["NYSE"]), (2, None, None, None), (3, "", "en", []),
            (None, prose(60, 3), "en", ["NYSE", None]), (4, long, "en", [None]), (5, " \n\t ", "en", ["AMEX"]),
            (6, "a" * 50_000, None, ["AMEX", "NYSE"]), (7, "Ünïcödé 😀   text\x1c here", "de", ["NYSE"])]


def table(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)
