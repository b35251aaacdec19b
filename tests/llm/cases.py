"""Documents that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, copies and near copies."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, length int, t string"


def texts() -> list:
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "É", "naïve", "x,y"]
    base = [r.choice(words) for _ in range(400)]
    near = []
    for k in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = r.choice(words) + str(k)
        near.append(" ".join(w))
    copies = [" ".join(base)] * 30
    some = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:120]
    short = ["", " ", "\n\t", "one", "one two", "One two", "one two three", "one two three four", "ONE two three four", None, None]
    long = " ".join(r.choice(words) for _ in range(30_000))
    odd = ["it's <|endoftext|> ok 12ab", "a\x1cb\x85c", "İstanbul KELVINK ſ", "x" * 5000, "the " * 700, "the " * 701, "the " * 702]
    return near + copies + some + short + [long, long + " tail"] + odd


def documents(spark, rows=None):
    """A table with extra columns whose names clash with those of results."""
    rows = texts() if rows is None else rows
    data = [(i, x, "en", "s", len(x or ""), 0.5, 1, "clash") for i, x in enumerate(rows)]
    if rows:
        data += [data[3], data[3], (None, rows[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS), data
