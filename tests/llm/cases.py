"""Small tables with nulls, empties, long texts, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, print string, first long, places string, keys string, length int, list int, rank int, n int"


def words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(n)]


def documents(seed=0):
    """(doc_id, text) with copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    shared = words(rng, 45)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += rng.randint(1, 3)

    for w in base:
        add(" ".join(w))
    add(" ".join(base[0]))
    add(" ".join(base[1][:40] + ["edited"] + base[1][41:]))
    add(" ".join(base[2] + base[2][-3:]))
    for w in base[3:8]:
        add(" ".join(w[:10] + shared + w[10:25]))
    add(" \n\t ")
    add("")
    add(None)
    add("one")
    add("one two three")
    add("same " * 70)
    add("same " * 70 + "end")
    add("É ñ ß 漢字   x y \x0b z 😀")
    add(" ".join(words(rng, 6000)))
    rows.append((n, rows[5][1]))
    return rows


def table(spark, rows=None, extra=()):
    rows = documents() if rows is None else rows
    full = [(i, t, ("aa", "bb", None)[k % 3], None if k % 5 == 0 else f"src{k % 4}", len(t) if t else None, 0.5, "p", 7, "x", "k", 3, 1, 2, 4) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full + list(extra), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
