"""Documents for the tests: a sample of the small table and awkward cases."""

from __future__ import annotations

import random

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key int"


def awkward() -> list[tuple]:
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    text = " ".join(words(300))
    edited = text.split()
    edited[100], edited[200] = "changed", "words"
    passage = " ".join(words(80))
    long = "\n".join(" ".join(words(12)) for _ in range(1500))
    line = "A line of some length that stands in several documents, now and then altered."
    texts = [
        None, "", " \n\t ", "one", "one two three four", "ONE two Three four", text, text, " ".join(edited), text.upper(),
        " ".join(words(120)) + " " + passage + " " + " ".join(words(90)), " ".join(words(60)) + "\n" + passage + "\n" + " ".join(words(10)),
        long, long + " tail", "x " * 3000, "x " * 2999 + "y", "éè\U0001f600 café   nbsp" * 30,
        line, line.replace("several", "sevaral") + "\n" + line, "\n\n" + line + "\n" + "z" * 50, "z" * 49, "z" * 51,
        'password = "abcdefgh1" token=short secret:abc=defghijk AKIA1234567890ABCD AKIAX ' + "0123456789abcdef" * 2 + " api_key='x'",
        "prefix token = token= \"abcdefghij and passwd=secret=12345678", "key 9fK2mQ7xZp4LwT8vB3nRd6Yc1Js5Hg0A end get_user_name_from_index_2000",
    ]
    rows = [(10_000 + i, t, "en", None if i % 3 == 0 else f"s{i % 4}", len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[6]]  # a repeated row


def documents(spark, sf_dir: str, n: int = 150):
    base = pd.read_parquet(f"{sf_dir}/documents.parquet").head(n)
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), None, None) for r in base.itertuples()]
    return spark.createDataFrame(rows + awkward(), SCHEMA).repartition(3)


def texts(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
