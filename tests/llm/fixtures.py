"""Small tables with every awkward row, for all corpus operators."""

from __future__ import annotations

import random

#: Columns that clash with names the operators use inside.
EXTRA = ("_id", "key", "p", "node", "rid", "slot", "fp", "size", "t")


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))


def document_rows(seed: int = 7) -> list[tuple]:
    r = random.Random(seed)
    base = [words(r, 40) for _ in range(12)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "s0") for i in range(30)]  # a hot group of copies
    rows += [(200, base[1].replace(" ", "\n ", 3), "s1"), (201, base[2] + " \t", "s2")]
    rows += [(202, "", "s1"), (203, None, "s1"), (204, " \n\t ", None), (205, "one two", None)]
    rows += [(206, base[3] + " zz", "s3"), (207, base[4].upper(), "é"), (208, "a b c d " * 60, "s1")]
    rows += [(209, words(r, 20000), "s2")]  # a very long text
    rows += [(210, "*** ### " * 20, "s0"), (211, "same line\n" * 30, "s0"), (212, "漢字 🙂 <|endoftext|> x\x1cy\x85z  end ", "s0")]
    rows += [(3, base[3], "s3")]  # a row that repeats
    rows += [(None, base[5], "s1")]  # no id
    r.shuffle(rows)
    return rows


def documents(spark, rows=None):
    rows = document_rows() if rows is None else rows
    names = ", ".join(f"`{c}` int" for c in EXTRA)
    data = [(i, t, "en", s, len(t or ""), *([1] * len(EXTRA))) for i, t, s in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(5)


def empty(spark):
    return documents(spark, [])
